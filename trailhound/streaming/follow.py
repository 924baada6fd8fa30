"""Incremental loading: new log files of a folder go through the same ingest job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailhound.sources.ingest import ingest
from trailhound.sources.store import EventStore

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def follow(
    spark: SparkSession,
    path: str,
    store: EventStore,
    checkpoint: str,
    default_year: int,
    zone: str = "UTC",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Load every file not loaded yet, batch by batch, and stop when none is left.

    Only file names (at most `files_per_batch`) reach the driver. A batch that is run
    again after a failure stores nothing twice: ingest drops what the store already has.
    """

    def load(batch: DataFrame, _: int) -> None:
        files = sorted(row["path"] for row in batch.collect())
        if files:
            ingest(spark, files, store, default_year, zone)

    names = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select("path")
    )
    return (
        names.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
