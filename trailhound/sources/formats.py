"""Known log formats and which one a file is."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.functions.json_values import strict_json
from trailhound.functions.text import strip
from trailhound.sources import cloudaudit, hostlog

# Lines looked at per file, and the score a format must reach.
SAMPLE_LINES = 200
MIN_CONFIDENCE = 0.3


@dataclass(frozen=True)
class LogFormat:
    """`score` aggregates sample lines of a file; `parse` turns lines into event rows. Of a
    format with `whole_files` it also gets `documents` (file, content) and, of large files, the
    values of their lists as `values` (file, line_no, v, odd)."""

    source_type: str
    score: Callable[[], Column]
    parse: Callable[..., DataFrame]
    whole_files: bool = False


def parse_cloud(lines: DataFrame, documents: DataFrame, values: DataFrame | None = None, **_) -> DataFrame:
    records = cloudaudit.line_records(lines).unionByName(cloudaudit.document_records(documents))
    if values is not None:
        records = records.unionByName(cloudaudit.of_values(values))
    return cloudaudit.parse_records(records)


def parse_host(lines: DataFrame, default_year: int, zone: str = "UTC", **_) -> DataFrame:
    return hostlog.parse(lines, default_year, zone)


# In registration order: of equal scores the earlier format wins.
DEFAULT_FORMATS: tuple[LogFormat, ...] = (
    LogFormat(hostlog.SOURCE_TYPE, hostlog.score, parse_host),
    LogFormat(cloudaudit.SOURCE_TYPE, cloudaudit.score, parse_cloud, whole_files=True),
)


def detect_formats(
    lines: DataFrame,
    formats: Sequence[LogFormat] = DEFAULT_FORMATS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(file, source_type, confidence, line_delimited); source_type NULL when none fits.

    `line_delimited` tells JSON lines from one JSON document: a first line that is a
    complete value with more text after it cannot be one document.
    """
    sample = lines.filter(F.col("line_no") <= SAMPLE_LINES)
    value = strip(F.col("value"))
    first = F.min_by(value, F.when(value != "", F.col("line_no")))
    scored = sample.groupBy("file").agg(
        *[fmt.score().alias(f"s{i}") for i, fmt in enumerate(formats)],
        (F.count_if(value != "") > 0).alias("has_text"),
        (
            strict_json(first).isNotNull() & (F.count_if(value != "") > 1)
        ).alias("line_delimited"),
    )
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(formats))]) if len(formats) > 1 else F.col("s0")
    winner = F.lit(None).cast("string")
    for i, fmt in reversed(list(enumerate(formats))):
        winner = F.when(F.col(f"s{i}") == F.col("confidence"), fmt.source_type).otherwise(winner)
    return (
        scored.withColumn("confidence", F.when(F.col("has_text"), best).otherwise(0.0))
        .select(
            "file",
            F.when(F.col("has_text") & (F.col("confidence") >= min_confidence), winner).alias("source_type"),
            "confidence", "line_delimited",
        )
    )


def without_lines(files: DataFrame, detected: DataFrame) -> DataFrame:
    """The files that detection saw no line of, as if detected with score 0."""
    # The index and the scan may write the slashes behind a scheme differently.
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    seen = detected.select(plain("file").alias("seen"))
    return files.join(seen, plain("file") == F.col("seen"), "left_anti").select(
        "file", F.lit(None).cast("string").alias("source_type"), F.lit(0.0).alias("confidence"),
        F.lit(False).alias("line_delimited"),
    )


def rejected_files(
    detected: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    formats: Sequence[LogFormat] = DEFAULT_FORMATS,
) -> DataFrame:
    """Files no format fits, with the best score, the floor and the formats there are;
    nothing of them is loaded."""
    return detected.filter(F.col("source_type").isNull()).select(
        "file", F.lit("unrecognised log format").alias("error"),
        F.round("confidence", 3).alias("best_confidence"),
        F.lit(min_confidence).alias("min_confidence"),
        F.lit(", ".join(f.source_type for f in formats)).alias("supported"),
    )
