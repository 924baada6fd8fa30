"""Log files as numbered lines, or as whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailhound.session import materialize

# Line breaks a text reader does not split on but Python's splitlines does.
RARE_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
ANY_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Splits follow the cores there are when a read begins; within, all reads take those of now."""
    name = "spark.sql.files.minPartitionNum"
    given = spark.conf.get(name, None)
    spark.conf.set(name, given or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, given) if given else spark.conf.unset(name)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value, mark), bad bytes replaced, as a written table; `mark` is the rare
    break before a line, if it is no common one.

    Files stay splittable: a line's number is its place in its block plus the lines of
    the blocks before it, so no file is read by a single task. Files without a byte have
    no row here, as in any Spark scan; `all_files` names them.
    """
    read = spark.read.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("slice"),
        F.monotonically_increasing_id().alias("seq"),
    )
    rare = F.col("value").rlike(RARE_BREAKS)
    pieces = F.size(F.split("value", RARE_BREAKS))
    # The rows of a block are read one after the other, so their ids are consecutive and a
    # line's place in its block is a subtraction. One small row per block is joined back; it is
    # written first, so Spark knows its size, and while that is small enough to broadcast, the
    # text itself is never shuffled.
    before = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        read.groupBy("file", "slice")
        .agg(
            F.min("seq").alias("first"),
            F.sum(F.when(rare, pieces).otherwise(1)).alias("lines"),
            F.max(rare).alias("odd"),
        )
        .withColumn("carry", F.coalesce(F.sum("lines").over(before), F.lit(0)))
        .drop("lines")
    )
    with same_splits(spark):
        blocks = materialize(blocks)
        placed = read.join(blocks, ["file", "slice"])
        plain = placed.filter(~F.col("odd")).select(
            "file", (F.col("carry") + F.col("seq") - F.col("first") + 1).alias("line_no"), "value",
            F.lit(None).cast("string").alias("mark"),
        )
        if blocks.filter("odd").isEmpty():
            return materialize(plain)
        within = Window.partitionBy("file", "slice").orderBy("seq", "piece")
        odd = (
            placed.filter("odd")
            .select(
                "file", "slice", "seq", "carry", F.regexp_extract_all("value", F.lit(f"({RARE_BREAKS})"), F.lit(1)).alias("marks"),
                F.posexplode(F.split("value", RARE_BREAKS)).alias("piece", "value"),
            )
            .select(
                "file", (F.col("carry") + F.row_number().over(within)).alias("line_no"), "value",
                F.when(F.col("piece") > 0, F.try_element_at("marks", F.col("piece"))).alias("mark"),
            )
        )
        return materialize(plain.unionByName(odd))


def no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, line_no long, value string, mark string")


def all_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file): every file of the input, also those without a byte, which no scan shows.

    The names are those of the file index, which the driver holds for any scan.
    """
    return spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")


def whole_texts(lines: DataFrame) -> DataFrame:
    """(file, content): the text of each file from its numbered lines. A file is one row."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.concat(F.coalesce("mark", F.lit("\n")), "value").alias("text"))))
    return lines.groupBy("file").agg(
        F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), ""), 2, 2**31 - 1).alias("content")
    )


def document_lines(documents: DataFrame) -> DataFrame:
    parts = F.split("content", ANY_BREAK)
    return documents.select("file", F.posexplode(parts).alias("at", "value")).select(
        "file", (F.col("at") + 1).cast("long").alias("line_no"), "value"
    )
