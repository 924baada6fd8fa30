"""Entity keys: the namespaced identifiers an event touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.functions.text import casefold

# Namespace, event column, whether the value is case-folded.
NAMESPACES = (
    ("ip", "source_ip", False),
    ("user", "actor_name", True),
    ("principal", "actor_id", False),
    ("host", "host", True),
    ("account", "account", True),
)
# Which namespace an analyst pivots on first.
PRECEDENCE = ("principal", "account", "ip", "host", "user")


def entity_keys() -> Column:
    parts = []
    for namespace, column, folded in NAMESPACES:
        value = casefold(F.col(column)) if folded else F.col(column)
        parts.append(
            F.when(F.col(column) != "", F.concat(F.lit(f"{namespace}:"), value))
        )
    return F.array_compact(F.array(*parts))


def key_rank(key: Column) -> Column:
    expr = F.lit(len(PRECEDENCE))
    for rank, namespace in reversed(list(enumerate(PRECEDENCE))):
        expr = F.when(key.startswith(f"{namespace}:"), rank).otherwise(expr)
    return expr


def with_entity_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("entity_keys", entity_keys())


def fan_out(events: DataFrame, *columns: str) -> DataFrame:
    """One row per (event, entity key it touches)."""
    return events.select(
        F.explode("entity_keys").alias("entity_key"), *[F.col(c) for c in columns]
    )


def event_entities(events: DataFrame) -> DataFrame:
    return fan_out(events, "event_id").select("event_id", "entity_key")


def touching(events: DataFrame, key: str, since, until) -> DataFrame:
    """Everything touching one key in a time span.

    The time filter reaches the scan, and where events are stored by date its bounds choose
    the folders to read; the key test is on the array column, so no join back to an entity
    table is needed.
    """
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date").between(
            F.lit(since).cast("timestamp").cast("date"), F.lit(until).cast("timestamp").cast("date")))
    return events.filter(
        F.col("ts").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
        & F.array_contains("entity_keys", key)
    )
