"""Session settings every job relies on, and the place lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "trailhound", **conf) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    pin_settings(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_settings(spark: SparkSession) -> None:
    """Times are UTC; of repeated keys in a JSON object the last one counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="trailhound-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once as parquet in the checkpoint folder and read them back.

    Cuts the lineage like a checkpoint, survives lost executors, and unlike one keeps
    column pruning and size statistics for the stages that read it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/trailhound-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(written: DataFrame) -> None:
    """Delete a table that `materialize` wrote and that nothing will read any more."""
    spark = written.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.written_to)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
