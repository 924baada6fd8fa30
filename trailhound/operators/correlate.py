"""Join findings into incidents.

Findings that share an entity close in time belong to one story; entities seen with too
many others identify nothing and do not join. Every step is a grouped aggregate or an
equi join; the only per-incident ordering, the digest behind the incident id, is a
stream over sorted rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailhound.functions.entities import key_rank
from trailhound.operators import slices
from trailhound.operators.catalog import resolve
from trailhound.operators.detect import Detection
from trailhound.operators.graph import connected_components
from trailhound.operators.rules import HOUR
from trailhound.schema import SEVERITIES, severity_name
from trailhound.session import materialize

# Linking gap, breadth above which a key is ambient, tactic counts that
# raise the severity by one and two rungs, characters of the incident digest.
MAX_GAP_US = HOUR
MAX_COOCCURRING_KEYS = 12
ONE_RUNG, TWO_RUNGS = 3, 5
ID_CHARS = 8
# Bytes of the raw text's hash by which an incident's records are told apart.
RAW_BYTES = 16

# An incident of one finding that shares no key is named by it.
ALONE = "finding#"

ORDER = ("first_us", "entity_key", "rule_order", "anchor_us", "anchor_event")


@dataclass(frozen=True)
class Correlation:
    """incidents: one row each. members: finding -> incident, with `kept`.

    detail: evidence rows with what later queries need (hashes, source, category).
    records: each stored record once per incident, hashes as bytes.
    `incident_key` is the join key; `incident_id` is the short public name.
    """

    incidents: DataFrame
    members: DataFrame
    detail: DataFrame
    records: DataFrame


def packed(*hashes: str) -> list[Column]:
    """Hashes as bytes, which sort like their digits, for rows on their way through a shuffle."""
    return [F.unhex(name).alias(name) for name in hashes]


def digits(*hashes: str) -> dict[str, Column]:
    return {name: F.lower(F.hex(name)) for name in hashes}


def evidence_detail(detection: Detection, events: DataFrame) -> DataFrame:
    rows = detection.evidence.join(
        events.select(
            "event_id", "entity_keys", *packed("evidence_hash", "raw_hash"), "source_type", "category"
        ).withColumn("raw_hash", F.substring("raw_hash", 1, RAW_BYTES)),
        "event_id",
    )
    return rows.withColumns(digits("evidence_hash", "raw_hash"))


def noisy_keys(detail: DataFrame, breadth: int = MAX_COOCCURRING_KEYS) -> DataFrame:
    """Keys seen, inside evidence, with more than `breadth` distinct other keys."""
    sets = detail.select("entity_keys").distinct()
    pairs = (
        sets.select(F.explode("entity_keys").alias("entity_key"), "entity_keys")
        .select("entity_key", F.explode("entity_keys").alias("other"))
        .filter(F.col("other") != F.col("entity_key"))
        .distinct()
    )
    return (
        pairs.groupBy("entity_key")
        .agg(F.count(F.lit(1)).alias("breadth"))
        .filter(F.col("breadth") > breadth)
    )


def joinable_keys(findings: DataFrame, detail: DataFrame, noisy: DataFrame) -> DataFrame:
    """(finding_id, key): every key its evidence touches and its own, ambient ones removed.

    They go first: most rows are of ambient keys. Pass `noisy` as a written table, whose size
    Spark knows, so that the rows need not be shuffled to find them.
    """
    touched = detail.select("finding_id", F.explode("entity_keys").alias("key"))
    filed = findings.select("finding_id", F.col("entity_key").alias("key"))
    ambient = noisy.select(F.col("entity_key").alias("key"))
    return touched.unionByName(filed).join(ambient, "key", "left_anti").distinct()


def key_segments(findings: DataFrame, keys: DataFrame, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """Split each key's findings where the next one starts too long after the previous ended."""
    timed = findings.select(
        "finding_id", "entity_key", "rule_order", "anchor_us", "anchor_event",
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
    )
    rows = keys.join(timed, "finding_id").withColumn(
        "slice", F.coalesce(slices.slice_of(F.col("first_us"), HOUR), F.lit(-(1 << 62)))
    )
    gaps = slices.previous_row(rows, ["key"], ORDER, {"prev_last": "last_us"}).withColumn(
        "split",
        F.coalesce((F.col("first_us") - F.col("prev_last") > max_gap_us), F.lit(False)).cast("long"),
    )
    return slices.running_totals(gaps, ["key"], ORDER, {"segment": "split"}).select(
        "finding_id", "key", "segment"
    )


def alone() -> Column:
    return F.concat(F.lit(ALONE), "finding_id")


def finding_components(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """The findings with their incident_key.

    Nodes are key segments and a finding links the segments it lies in, so the many
    findings over the same segments shrink to one edge before the graph is walked. The
    findings that lie in a segment are written with their components: where they are few, Spark
    sends them to the findings, which then need not be shuffled.
    """
    placed = segments.select(
        "finding_id", F.concat_ws("#", "key", F.col("segment").cast("string")).alias("node")
    )
    anchors = placed.groupBy("finding_id").agg(F.min("node").alias("anchor"))
    edges = (
        placed.join(anchors, "finding_id")
        .select(F.col("anchor").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    labels = connected_components(edges)
    linked = materialize(
        anchors.join(labels.withColumnRenamed("node", "anchor"), "anchor").select("finding_id", "component")
    )
    return (
        findings.join(linked, "finding_id", "left")
        .withColumn("incident_key", F.coalesce("component", alone()))
        .drop("component")
    )


def width_order() -> Column:
    """Widest evidence first, then the entity an analyst would pivot on."""
    return F.struct(
        (-F.col("evidence_count")).alias("o1"), key_rank(F.col("entity_key")).alias("o2"),
        F.col("entity_key").alias("o3"), F.col("rule_order").alias("o4"),
        F.col("anchor_us").alias("o5"), F.col("anchor_event").alias("o6"),
    )


def absorbed(members: DataFrame, detail: DataFrame) -> DataFrame:
    """finding_id of every finding whose evidence lies inside a wider one of its rule.

    Containment is transitive, so testing against all findings equals testing against
    the kept ones. Findings over equal evidence are told by a signature of the set, and the
    first of them stands for all, so copies are never paired. What stands is inside another
    only if that one has its rarest hash, too: only those are compared, by counting. A finding
    that is the only one of its rule in its incident is left out from the start.
    """
    several = members.groupBy("incident_key", "rule_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ordered = materialize(
        members.join(several.select("incident_key", "rule_id"), ["incident_key", "rule_id"], "left_semi")
        .select("finding_id", "incident_key", "rule_id", width_order().alias("ord"))
    )
    hashes = materialize(
        detail.select("finding_id", "evidence_hash").join(ordered.select("finding_id"), "finding_id", "left_semi").distinct()
    )
    # Sums of two parts of the hashes name a set whatever the order of its rows.
    part = lambda at: F.sum(F.conv(F.substring("evidence_hash", at, 15), 16, 10).cast("decimal(20,0)"))
    sets = hashes.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("size"), part(1).alias("sign_1"), part(16).alias("sign_2"))
    sized = materialize(ordered.join(sets, "finding_id"))
    sign = ["incident_key", "rule_id", "size", "sign_1", "sign_2"]
    firsts = sized.groupBy(*sign).agg(F.min_by("finding_id", "ord").alias("first"), F.min("ord").alias("ord"))
    firsts = materialize(firsts)
    copies = sized.join(firsts.select(*sign, "first"), sign).filter(F.col("finding_id") != F.col("first"))

    group = ["incident_key", "rule_id", "evidence_hash"]
    rows = materialize(
        firsts.withColumnRenamed("first", "finding_id").join(hashes, "finding_id")
        .select("finding_id", *group, "ord", "size")
    )
    holders = Window.partitionBy(*group)
    placed = rows.withColumns({"holders": F.count(F.lit(1)).over(holders), "first_ord": F.min("ord").over(holders)})
    single = placed.filter((F.col("size") == 1) & (F.col("first_ord") < F.col("ord")))
    rarest = (
        placed.filter("size > 1").groupBy("finding_id", "incident_key", "rule_id", "ord", "size")
        .agg(F.min(F.struct("holders", "evidence_hash")).alias("r"))
        .filter("r.holders > 1")
        .select("finding_id", "incident_key", "rule_id", F.col("r.evidence_hash").alias("evidence_hash"), "ord", "size")
    )
    wide = rows.filter("size > 1").select(
        *group, F.col("finding_id").alias("wider"), F.col("ord").alias("wider_ord"), F.col("size").alias("wider_size")
    )
    pairs = rarest.join(wide, group).filter(
        (F.col("wider_ord") < F.col("ord")) & (F.col("wider_size") > F.col("size"))
    ).select("finding_id", "wider", "size")
    own = rows.select("finding_id", "evidence_hash")
    inside = (
        pairs.join(own, "finding_id")
        .join(own.withColumnRenamed("finding_id", "wider"), ["wider", "evidence_hash"])
        .groupBy("finding_id", "wider", "size")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter("shared = size")
    )
    # A copy goes with the finding that stands for it, or because of it.
    return (
        copies.select("finding_id").unionByName(single.select("finding_id")).unionByName(inside.select("finding_id"))
        .distinct()
    )


def digest_stream(chars: int):
    """Arrow function over records sorted by (incident_key, evidence_hash): passes them on, and
    behind an incident's last one a row of only its key and its id.

    A nested function, so that Spark ships it by value to workers without this package.
    """
    import hashlib

    import pyarrow as pa

    def stream(batches):
        current, digest, last, done, schema = None, None, None, [], None

        def ids():
            keys = pa.array([k for k, _ in done], pa.string())
            names = pa.array([f"INC-{d.hexdigest()[:chars]}" for _, d in done], pa.string())
            done.clear()
            empty = [pa.nulls(len(keys), f.type) for f in list(schema)[1:-1]]
            return pa.RecordBatch.from_arrays([keys, *empty, names], schema=schema)

        for batch in batches:
            schema = batch.schema.append(pa.field("incident_id", pa.string()))
            schema = pa.schema([f.with_nullable(True) for f in schema])
            keys = batch.column("incident_key").to_pylist()
            hashes = batch.column("evidence_hash").to_pylist()
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                told = list(dict.fromkeys(hashes[start:end]))
                if digest is not None and keys[start] == current:
                    told = told[told[0] == last:]
                    digest.update("".join(f"|{h.hex()}" for h in told).encode())
                else:
                    if digest is not None:
                        done.append((current, digest))
                    current, digest = keys[start], hashlib.sha256("|".join(h.hex() for h in told).encode())
                start, last = end, hashes[end - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(keys), pa.string())], schema=schema)
            yield ids()
        if digest is not None:
            done.append((current, digest))
            yield ids()

    return stream


def kept_records(members: DataFrame, detail: DataFrame) -> DataFrame:
    """(incident_key, source_type, evidence_hash, raw_hash), hashes as bytes: each stored record
    once per incident, however many findings hold it. The evidence hash covers the source.
    Raw texts are told by as many bits (128) as evidence.

    Findings alone in their incident name it, so only the others are looked up. They are written
    first: where they are few, Spark sends them to the evidence, which is shuffled once, by incident.
    """
    others = materialize(
        members.filter(~F.col("kept") | (F.col("incident_key") != alone())).select("finding_id", "incident_key", "kept")
    )
    return (
        detail.select("finding_id", *packed("evidence_hash", "raw_hash"), "source_type")
        .join(others, "finding_id", "left")
        .filter(F.coalesce("kept", F.lit(True)))
        .select(F.coalesce("incident_key", alone()).alias("incident_key"), "source_type", "evidence_hash", "raw_hash")
        .repartition("incident_key")
        .distinct()
    )


def records_and_ids(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, written once, and (incident_key, incident_id) from the same table: `INC-` and
    eight digits of the sha256 over an incident's sorted evidence hashes.

    The digest needs the hashes one after the other. They are sorted by Spark (which can
    spill) and streamed through the hash, so an incident of any size takes little memory.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    written = materialize(
        records.sortWithinPartitions("incident_key", "evidence_hash")
        .mapInArrow(digest_stream(ID_CHARS), f"{columns}, incident_id string")
    )
    return (
        written.filter("incident_id IS NULL").drop("incident_id"),
        written.filter("incident_id IS NOT NULL").select("incident_key", "incident_id"),
    )


def escalate(base: Column, tactic_count: Column) -> Column:
    """Raise the loudest severity by how many tactics are seen, up to the top rung."""
    ladder = sorted(SEVERITIES.values())
    rung = F.array_position(F.array(*[F.lit(s) for s in ladder]), base)
    steps = F.when(tactic_count >= TWO_RUNGS, 2).when(tactic_count >= ONE_RUNG, 1).otherwise(0)
    return F.element_at(
        F.array(*[F.lit(s) for s in ladder]),
        F.least(rung + steps, F.lit(len(ladder))).cast("int"),
    )


def source_counts(records: DataFrame) -> DataFrame:
    """(incident_key, source_type, event_count), each stored record counted once."""
    return records.groupBy("incident_key", "source_type").agg(F.count(F.lit(1)).alias("event_count"))


def _tactic_rows(members: DataFrame, catalog: DataFrame) -> DataFrame:
    return resolve(
        members.filter("kept").select("incident_key", "technique").distinct(), catalog
    ).select("incident_key", F.explode("tactics").alias("tactic"))


def incident_tactics(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """(incident_key, tactic) from the rules' own techniques, never from proposed ones."""
    return _tactic_rows(members, catalog).distinct()


def assemble(members: DataFrame, records: DataFrame, ids: DataFrame, catalog: DataFrame) -> DataFrame:
    of_kept = lambda column: F.when(F.col("kept"), F.col(column))
    whole = members.groupBy("incident_key").agg(
        F.max(of_kept("severity")).alias("base"),
        F.count_if("kept").alias("finding_count"),
        F.array_sort(F.collect_set(of_kept("rule_id"))).alias("rule_ids"),
        F.min(of_kept("first_seen")).alias("first_seen"),
        F.max(of_kept("last_seen")).alias("last_seen"),
        F.array_sort(F.collect_set("entity_key")).alias("entity_keys"),
        F.min_by("entity_key", F.struct(key_rank(F.col("entity_key")), "entity_key")).alias("primary_entity"),
    ).filter("finding_count > 0")
    tactics = _tactic_rows(members, catalog).groupBy("incident_key").agg(
        F.array_sort(F.collect_set("tactic")).alias("tactics")
    )
    sources = source_counts(records).groupBy("incident_key").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("event_count")).alias("neg"), "source_type"))
        ).alias("s")
    ).select(
        "incident_key",
        F.expr("transform(s, x -> struct(x.source_type as source_type, -x.neg as event_count))").alias("sources"),
    )
    empty = F.array().cast("array<string>")
    return (
        whole.join(ids, "incident_key")
        .join(sources, "incident_key")
        .join(tactics, "incident_key", "left")
        .withColumn("tactics", F.coalesce("tactics", empty))
        .withColumn("tactic_count", F.size("tactics"))
        .withColumn("severity_score", escalate(F.col("base"), F.col("tactic_count")))
        .select(
            "incident_key", "incident_id", severity_name(F.col("severity_score")).alias("severity"),
            "severity_score", "primary_entity", "finding_count", "tactic_count", "tactics",
            "sources", "entity_keys", "rule_ids", "first_seen", "last_seen",
        )
    )


def correlate(
    detection: Detection,
    events: DataFrame,
    catalog: DataFrame,
    max_gap_us: int = MAX_GAP_US,
    breadth: int = MAX_COOCCURRING_KEYS,
) -> Correlation:
    """Incidents of one detection pass. Pass a materialized detection."""
    findings = detection.findings
    detail = materialize(evidence_detail(detection, events))
    keys = joinable_keys(findings, detail, materialize(noisy_keys(detail, breadth)))
    segments = materialize(key_segments(findings, keys, max_gap_us))
    members = materialize(finding_components(findings, segments))
    dropped = materialize(absorbed(members, detail)).withColumn("_dropped", F.lit(True))
    members = materialize(
        members.join(dropped, "finding_id", "left")
        .withColumn("kept", F.col("_dropped").isNull())
        .drop("_dropped")
    )
    records, ids = records_and_ids(kept_records(members, detail))
    incidents = materialize(assemble(members, records, ids, catalog))
    return Correlation(incidents, members, detail, records)
