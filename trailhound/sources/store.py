"""The event store: parquet tables partitioned by load and event date.

A load writes its rows under a name of its own, and last its run records, which are the mark
that it is complete: readers see only rows of loads that have some. A load that fails between
leaves rows that nobody sees; loading again writes them anew, so nothing is lost or doubled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from trailhound.schema import EVENT

STORED_EVENT = T.StructType(
    [
        *EVENT.fields,
        T.StructField("entity_keys", T.ArrayType(T.StringType())),
        T.StructField("dedup_hash", T.StringType()),
        T.StructField("evidence_hash", T.StringType()),
        T.StructField("raw_hash", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)
INGEST = T.StructType(
    [
        T.StructField("ingest_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("detected_confidence", T.DoubleType()),
        T.StructField("lines_read", T.LongType()),
        T.StructField("events_emitted", T.LongType()),
        T.StructField("lines_skipped", T.LongType()),
        T.StructField("events_persisted", T.LongType()),
        T.StructField("duplicates_skipped", T.LongType()),
        T.StructField("load", T.StringType()),
    ]
)
LOAD = T.StructField("load", T.StringType())
#: The load of rows that are written without a run; they are always seen.
WITHOUT_RUN = "none"
PARSE_ERROR = T.StructType(
    [
        T.StructField("ingest_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("excerpt", T.StringType()),
    ]
)


def _with_load(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, LOAD])


@dataclass(frozen=True)
class EventStore:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _complete(self, rows: DataFrame) -> DataFrame:
        """Rows of complete loads. The load is a folder, so those of others are not read.

        The names of loads are sent to all tasks: by a shuffle, all rows of a load would go to one."""
        loads = self.ingests().select("load").unionByName(self.spark.createDataFrame([(WITHOUT_RUN,)], "load string"))
        return rows.join(F.broadcast(loads.distinct()), "load", "left_semi").drop("load")

    def events(self) -> DataFrame:
        """Stored events. Order by time is left to the windows that need it."""
        return self._complete(self._read("events", _with_load(STORED_EVENT)))

    def events_of(self, load: str) -> DataFrame:
        """The events of one load, also while it is not complete."""
        return self._read("events", _with_load(STORED_EVENT)).filter(F.col("load") == load).drop("load", "event_date")

    def events_between(self, since=None, until=None) -> DataFrame:
        """Stored events from `since` (inclusive) up to `until` (exclusive), in order of time.

        The bounds also hold on the partition column, so other days are not read."""
        rows = self.events()
        if since is not None:
            rows = rows.filter((F.col("event_date") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
        if until is not None:
            rows = rows.filter((F.col("event_date") <= F.to_date(F.lit(until))) & (F.col("ts") < F.lit(until)))
        return rows.orderBy("ts", "event_id")

    def errors(self) -> DataFrame:
        """Every record that could not be read, of all complete loads."""
        return self._complete(self._read("errors", _with_load(PARSE_ERROR)))

    def ingests(self) -> DataFrame:
        return self._read("ingests", INGEST)

    def last_ingest_id(self) -> int:
        return self.ingests().agg(F.coalesce(F.max("ingest_id"), F.lit(0))).first()[0]

    def append_events(self, events: DataFrame, load: str = WITHOUT_RUN) -> None:
        (
            events.withColumn("event_date", F.to_date("ts"))
            .select(*STORED_EVENT.fieldNames(), F.lit(load).alias("load"))
            .hint("rebalance", F.col("event_date"))
            .write.mode("append").partitionBy("load", "event_date").parquet(f"{self.root}/events")
        )

    def append_errors(self, errors: DataFrame, load: str = WITHOUT_RUN) -> None:
        errors.select(
            *[F.col(f.name).cast(f.dataType) for f in PARSE_ERROR.fields], F.lit(load).alias("load")
        ).write.mode("append").partitionBy("load").parquet(f"{self.root}/errors")

    def append_ingests(self, ingests: DataFrame) -> None:
        """The run records of a load, which complete it."""
        ingests.select(
            *[F.col(f.name).cast(f.dataType) for f in INGEST.fields]
        ).write.mode("append").parquet(f"{self.root}/ingests")
