"""Files to stored events: detect, parse, deduplicate, append, and account for it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailhound.functions.entities import with_entity_keys
from trailhound.functions.hashing import with_hashes
from trailhound.operators.slices import running_totals
from trailhound.schema import EVENT, conform
from trailhound.session import materialize, pin_settings
from trailhound.sources.formats import (
    DEFAULT_FORMATS, MIN_CONFIDENCE, LogFormat, detect_formats, rejected_files, without_lines,
)
from trailhound.sources.documents import LARGE_BYTES, CutDocuments, as_patterns, cut_documents, file_heads, large_files
from trailhound.sources.lines import all_files, no_lines, read_lines, whole_texts
from trailhound.sources.store import EventStore

SEQ_BITS = 36
FILE_SLICES = 1024


@dataclass(frozen=True)
class IngestResult:
    ingests: DataFrame
    parse_errors: DataFrame
    rejected: DataFrame
    fresh: DataFrame


def first_of_each(events: DataFrame, order: Sequence[str], key: str = "dedup_hash") -> DataFrame:
    """The first row of every fingerprint.

    `row_number() = 1` is cut down inside each map task before the shuffle, so many copies
    of one record do not travel to one reducer.
    """
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_at", at).filter("_at = 1").drop("_at")


def same_days(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored events of the days that the given events span, and those without a day.

    The time is part of a fingerprint, so equal ones lie on one day; other days' folders
    need not be read."""
    span = events.agg(F.min("ts").cast("date").alias("low"), F.max("ts").cast("date").alias("high")).first()
    day = F.col("event_date")
    if span is None or span["low"] is None:
        return stored.filter(day.isNull())
    return stored.filter(day.isNull() | day.between(F.lit(span["low"]), F.lit(span["high"])))


def not_stored(events: DataFrame, stored: DataFrame, key: str = "dedup_hash") -> DataFrame:
    return events.join(stored.select(key), key, "left_anti")


def parse_errors(parsed: DataFrame, limit: int | None = None, excerpt_chars: int | None = None) -> DataFrame:
    """Every record that could not be read. A report may ask for the first few of each file
    and short excerpts; the stored table has all of them."""
    excerpt = F.col("excerpt") if excerpt_chars is None else F.substring("excerpt", 1, excerpt_chars)
    rows = parsed.filter(F.col("error").isNotNull()).select(
        "file", "line_no", F.col("error").alias("reason"), excerpt.alias("excerpt")
    )
    if limit is None:
        return rows
    at = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return rows.withColumn("_at", at).filter(F.col("_at") <= limit).drop("_at")


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Per file: records read, emitted, skipped. A kept event with a bad date counts as both.

    Records that were no readable object were never read as records, only skipped.
    """
    unread = F.col("error").isin("record is not an object", "invalid JSON")
    return parsed.groupBy("file").agg(
        F.count_if(~F.coalesce(unread, F.lit(False))).alias("lines_read"),
        F.count_if("emitted").alias("events_emitted"),
        F.count_if(
            (~F.col("emitted") & ~F.col("blank")) | F.col("error").isNotNull()
        ).alias("lines_skipped"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def parse_files(
    detected: DataFrame,
    lines: DataFrame,
    formats: Sequence[LogFormat],
    cut: dict[str, CutDocuments] | None = None,
    **options,
) -> DataFrame:
    """Parse rows of every recognised file: event columns plus file, line_no, error.

    `cut` has by format the large documents that were cut into records before."""
    routed = lines.join(detected.filter(F.col("source_type").isNotNull()), "file")
    parsed = []
    for fmt in formats:
        mine = F.col("source_type") == fmt.source_type
        extra = dict(options)
        rows = routed.filter(mine)
        if fmt.whole_files:
            extra["documents"] = whole_texts(rows.filter(~F.col("line_delimited")))
            rows = rows.filter("line_delimited")
            if cut and fmt.source_type in cut:
                extra["values"] = cut[fmt.source_type].records
                extra["documents"] = extra["documents"].unionByName(cut[fmt.source_type].objects)
        out = fmt.parse(rows.select("file", "line_no", "value"), **extra)
        have = set(out.columns)
        parsed.append(
            out.select(
                "file", "line_no", "emitted", "blank", "error", "excerpt",
                *[
                    (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in EVENT.fields
                    if f.name not in ("event_id", "ingest_id")
                ],
            )
        )
    return reduce(DataFrame.unionByName, parsed)


@dataclass(frozen=True)
class Loaded:
    """Lines of all files but large documents, which format each file has, large documents cut."""

    lines: DataFrame
    detected: DataFrame
    cut: dict[str, CutDocuments]


def load_files(
    spark: SparkSession,
    path: str | list[str],
    formats: Sequence[LogFormat] = DEFAULT_FORMATS,
    min_confidence: float = MIN_CONFIDENCE,
    large_bytes: int = LARGE_BYTES,
) -> Loaded:
    """Number the lines once for detection and every parser, which read the written rows.

    Large files are looked at by their heads first: those that are one JSON document are cut
    into records and not read by lines, unless they turn out to be broken. Their names are all
    that the driver holds, at most one for each `large_bytes`."""
    told = []
    large = large_files(spark, path, large_bytes)
    if large:
        told = detect_formats(file_heads(spark, large), formats, min_confidence).filter(~F.col("line_delimited")).collect()
    whole = {f.source_type for f in formats if f.whole_files}
    names: dict[str, list[str]] = {}
    for row in told:
        if row["source_type"] in whole:
            names.setdefault(row["source_type"], []).append(row["file"])
    cut = {kind: cut_documents(spark, files) for kind, files in names.items()}
    broken = {r["file"] for c in cut.values() for r in c.broken.collect()}
    gone = {f for files in names.values() for f in files} - broken
    if not gone:
        lines = read_lines(spark, path)
    else:
        plain = {f.replace("///", "/"): f for f in spark.read.text(path).inputFiles()}
        rest = [f for short, f in plain.items() if short not in {g.replace("///", "/") for g in gone}]
        lines = read_lines(spark, as_patterns(rest)) if rest else no_lines(spark)
    found = materialize(detect_formats(lines, formats, min_confidence))
    if gone:
        kept = [r for r in told if r["file"] in gone]
        found = found.unionByName(spark.createDataFrame(kept, found.schema))
    if broken:  # read by lines, so each of them is one
        found = found.withColumn("line_delimited", F.col("line_delimited") | F.col("file").isin(sorted(broken)))
    return Loaded(lines, found.unionByName(without_lines(all_files(spark, path), found)), cut)


def ingest(
    spark: SparkSession,
    path: str | list[str],
    store: EventStore,
    default_year: int,
    zone: str = "UTC",
    formats: Sequence[LogFormat] = DEFAULT_FORMATS,
    min_confidence: float = MIN_CONFIDENCE,
    large_bytes: int = LARGE_BYTES,
) -> IngestResult:
    """Load log files into the store. Loading the same files again stores nothing new; a load that
    failed is as if it had not been."""
    pin_settings(spark)
    load = uuid.uuid4().hex
    loaded = load_files(spark, path, formats, min_confidence, large_bytes)
    detected = loaded.detected
    parsed = materialize(
        parse_files(detected, loaded.lines, formats, loaded.cut, default_year=default_year, zone=zone)
    )
    base = store.last_ingest_id()
    # Runs are numbered file by file; hash slices keep the numbering off a single task.
    recognised = detected.filter(F.col("source_type").isNotNull()).select(
        "*", F.lit(1).alias("one"), F.pmod(F.xxhash64("file"), F.lit(FILE_SLICES)).alias("slice")
    )
    files = materialize(
        running_totals(recognised, ["one"], ["file"], {"number": "one"})
        .withColumn("ingest_id", F.lit(base) + F.col("number"))
        .select("file", "ingest_id", "source_type", F.round("confidence", 3).alias("detected_confidence"))
    )
    numbered = (
        parsed.filter("emitted")
        .join(files.select("file", "ingest_id"), "file")
        .withColumn("event_id", F.shiftleft(F.col("ingest_id").cast("long"), SEQ_BITS) + F.col("line_no"))
    )
    hashed = with_hashes(with_entity_keys(conform(numbered)))
    # Written where they stay; the load's run records make them visible.
    store.append_events(
        not_stored(first_of_each(hashed, ["event_id"]), same_days(parsed.filter("emitted"), store.events())), load
    )
    fresh = store.events_of(load)
    persisted = fresh.groupBy("ingest_id").agg(F.count(F.lit(1)).alias("persisted"))
    ingests = (
        files.join(parse_stats(parsed).drop("errors"), "file", "left")
        .join(persisted, "ingest_id", "left")
        .select(
            "ingest_id", F.col("file").alias("filename"), "source_type", "detected_confidence",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines_read", "events_emitted", "lines_skipped")],
            F.coalesce("persisted", F.lit(0)).alias("events_persisted"),
            (F.coalesce("events_emitted", F.lit(0)) - F.coalesce("persisted", F.lit(0))).alias("duplicates_skipped"),
            F.lit(load).alias("load"),
        )
    )
    errors = parse_errors(parsed)
    ingests = materialize(ingests)
    store.append_errors(files.select("file", "ingest_id").join(errors, "file"), load)
    store.append_ingests(ingests)  # the load is complete
    return IngestResult(ingests.drop("load"), errors, rejected_files(detected, min_confidence, formats), fresh)
