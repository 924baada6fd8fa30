"""A fixed projection of the driver's `events` table onto normalized events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailhound.functions.entities import with_entity_keys
from trailhound.functions.hashing import with_hashes
from trailhound.schema import conform

T0 = 1_704_067_200_000_000  # 2024-01-01 UTC, microseconds
SQUEEZE = 720  # thirty days of rows become one hour of activity


def normalize_events(raw: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    squeezed = F.lit(T0) + F.floor((us - F.lit(T0)) / SQUEEZE)
    return raw.select(
        "event_id",
        F.lit(0).alias("ingest_id"),
        F.when(kind.isin("error", "signup"), "syslog_sshd").otherwise("aws_cloudtrail").alias("source_type"),
        F.concat_ws(" ", kind, F.concat(F.lit("u"), "user_id"), "props").alias("raw"),
        F.col("event_id").cast("string").alias("source_event_id"),
        F.timestamp_micros(squeezed).alias("ts"),
        F.when(kind.isin("error", "signup"), "authentication")
        .when(kind == "view", "configuration").otherwise("iam").alias("category"),
        F.when(kind.isin("error", "signup"), "login")
        .when(kind == "click", "policy_attach")
        .when(kind == "purchase", "access_key_create")
        .when(k % 20 == 0, "logging_stop").otherwise("trail_describe").alias("action"),
        F.when(kind == "error", "failure").otherwise("success").alias("outcome"),
        F.concat(F.lit("u"), "user_id").alias("actor_name"),
        F.lit("user").alias("actor_type"),
        F.concat_ws(".", F.lit("10.0"), F.col("user_id") % 4, k).alias("source_ip"),
        F.concat(F.lit("host"), F.col("user_id") % 7).alias("host"),
        F.concat(F.lit("res"), k % 10).alias("target_resource"),
        ((kind == "error") & (k % 3 == 0)).alias("invalid_user"),
        F.when(
            kind == "click",
            F.when(k % 25 == 0, "arn:aws:iam::aws:policy/AdministratorAccess").otherwise(
                "arn:aws:iam::aws:policy/ReadOnlyAccess"
            ),
        ).alias("policy_arn"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events with entity keys and both hashes."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_hashes(with_entity_keys(conform(normalize_events(raw))))
