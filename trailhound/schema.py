"""Fixed schemas and closed vocabularies of the event and incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Closed vocabularies.
SOURCE_TYPES = ("syslog_sshd", "windows_security", "aws_cloudtrail", "unknown")
CATEGORIES = (
    "authentication", "iam", "process", "network", "storage", "configuration", "other",
)
OUTCOMES = ("success", "failure", "unknown")
ACTOR_TYPES = ("user", "service", "role", "assumed_role", "unknown")
SEVERITIES = {"INFO": 10, "LOW": 30, "MEDIUM": 50, "HIGH": 70, "CRITICAL": 90}

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ingest_id", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("actor_name", T.StringType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("actor_type", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("target_resource", T.StringType()),
        T.StructField("invalid_user", T.BooleanType()),
        T.StructField("policy_arn", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

EVENT_DEFAULTS = {
    "source_type": "unknown",
    "category": "other",
    "action": "unknown",
    "outcome": "unknown",
    "actor_type": "unknown",
}

METADATA = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("leading_count", T.LongType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("distinct_values", T.ArrayType(T.StringType())),
        T.StructField("window", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("policy_arn", T.StringType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """Project any frame onto the event schema: missing columns NULL, defaults filled."""
    have = set(df.columns)
    columns = []
    for field in EVENT.fields:
        column = F.col(field.name) if field.name in have else F.lit(None)
        column = column.cast(field.dataType)
        if field.name in EVENT_DEFAULTS:
            column = F.coalesce(column, F.lit(EVENT_DEFAULTS[field.name]))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def severity_name(score: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, value in SEVERITIES.items():
        expr = F.when(score == value, name).otherwise(expr)
    return expr
