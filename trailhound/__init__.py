"""trailhound: raw security logs to ranked incidents, as Spark DataFrame jobs."""
