from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import models
from trailhound.functions.entities import PRECEDENCE
from trailhound.operators import correlate as cor
from trailhound.operators.catalog import TECHNIQUE, built_in_catalog
from trailhound.operators.detect import Detection
from trailhound.operators import graph
from trailhound.operators.graph import connected_components
from trailhound.schema import METADATA

SECOND = 1_000_000
HOUR = 3600 * SECOND


def rank(key):
    return PRECEDENCE.index(key.split(":")[0])


def build(spark, findings, events):
    """findings: dicts with entity_key, evidence (event ids), rule, severity, technique."""
    ats = {r.event_id: r.us for r in events.select("event_id", F.unix_micros("ts").alias("us")).collect()}
    rows, evidence = [], []
    for i, f in enumerate(findings):
        times = [ats[e] for e in f["evidence"] if ats[e] is not None]
        rows.append((
            f"f{i:04d}", f.get("rule", "r"), "t", f.get("severity", 50), f["entity_key"],
            f.get("technique"), f.get("proposed"), min(times, default=None), max(times, default=None),
            len(f["evidence"]), None, i, i, 0,
        ))
        evidence += [(f"f{i:04d}", e, ats[e]) for e in f["evidence"]]
    schema = (
        "finding_id string, rule_id string, title string, severity int, entity_key string, technique string, "
        "proposed_technique string, first_us long, last_us long, evidence_count long, m int, "
        "anchor_us long, anchor_event long, rule_order int"
    )
    table = spark.createDataFrame(rows, schema).select(
        "*", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
        F.lit(None).cast(METADATA).alias("metadata"),
    ).drop("first_us", "last_us", "m")
    return Detection(table, spark.createDataFrame(evidence, "finding_id string, event_id long, us long"), ())


def run(spark, findings, events, **kw):
    return cor.correlate(build(spark, findings, events), events, built_in_catalog(spark), **kw)


@pytest.mark.parametrize("hub_edges", [5, 1_000_000])
def test_components_match_search(spark, monkeypatch, hub_edges):
    monkeypatch.setattr(graph, "HUB_EDGES", hub_edges)
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(300):03d}", f"n{rnd.randrange(300):03d}") for _ in range(260)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a long chain
    pairs += [("hub", f"s{i:03d}") for i in range(200)] + [("alone", "alone")]
    got = connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in near:
        group, todo = set(), [node]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo.extend(near[x])
        want[node] = min(group)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


@pytest.mark.parametrize("seed,gap,breadth", [(1, 300, 12), (2, 60, 4), (3, 5000, 3)])
def test_random_findings_match_models(spark, make_events, seed, gap, breadth):
    rnd = random.Random(seed)
    events = make_events(
        [
            {
                "at": rnd.randrange(20_000), "actor_name": f"u{rnd.randrange(12)}",
                "source_ip": f"10.0.0.{rnd.randrange(12)}", "host": f"h{rnd.randrange(6)}",
            }
            for _ in range(150)
        ]
    )
    info = {
        r.event_id: r
        for r in events.select("event_id", "entity_keys", "evidence_hash", "raw", F.unix_micros("ts").alias("us")).collect()
    }
    findings = []
    for _ in range(60):
        key = rnd.choice(sorted({k for r in info.values() for k in r.entity_keys}))
        mine = [e for e, r in info.items() if key in r.entity_keys]
        findings.append(
            {
                "entity_key": key, "evidence": rnd.sample(mine, min(len(mine), rnd.randint(1, 4))),
                "rule": rnd.choice(["r1", "r2"]), "severity": rnd.choice([30, 50, 70]),
                "technique": rnd.choice(["T1110", "T1098", "T1087", None, "T1562.008"]),
            }
        )
    found = run(spark, findings, events, max_gap_us=gap * SECOND, breadth=breadth)
    keyed = {
        i: (f["entity_key"], f["evidence"], min(info[e].us for e in f["evidence"]),
            max(info[e].us for e in f["evidence"]), (f["entity_key"], 0, i))
        for i, f in enumerate(findings)
    }
    groups = models.components(keyed, gap * SECOND, breadth, {e: r.entity_keys for e, r in info.items()})
    members = found.members.collect()
    got = {}
    for m in members:
        got.setdefault(m.incident_key, set()).add(int(m.finding_id[1:]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))

    def place(i):
        f = findings[i]
        return (-len(f["evidence"]), rank(f["entity_key"]), f["entity_key"], i)

    signature = {i: {info[e].evidence_hash for e in f["evidence"]} for i, f in enumerate(findings)}
    kept = {
        i for g in groups for i in g
        if not any(
            place(j) < place(i) and findings[j]["rule"] == findings[i]["rule"] and signature[i] <= signature[j]
            for j in g
        )
    }
    assert {int(m.finding_id[1:]) for m in members if m.kept} == kept

    rows = {r.incident_key: r for r in found.incidents.collect()}
    for key, group in got.items():
        row, mine = rows[key], group & kept
        hashes = sorted(set().union(*(signature[i] for i in mine)))
        assert row.incident_id == "INC-" + hashlib.sha256("|".join(hashes).encode()).hexdigest()[:8]
        assert row.entity_keys == sorted({findings[i]["entity_key"] for i in group})
        assert row.primary_entity == min(row.entity_keys, key=lambda k: (rank(k), k))
        assert row.finding_count == len(mine)
        records = {(info[e].evidence_hash, info[e].raw) for i in mine for e in findings[i]["evidence"]}
        assert [(s.source_type, s.event_count) for s in row.sources] == [("syslog_sshd", len(records))]


def test_gap_edge(spark, make_events):
    for second, count in ((3600, 1), (3601, 2)):
        events = make_events([{"at": 0}, {"at": second}])
        fs = [{"entity_key": "host:web1", "evidence": [0]}, {"entity_key": "host:web1", "evidence": [1], "rule": "s"}]
        assert run(spark, fs, events).incidents.count() == count


def test_ambient_key_does_not_join_but_is_listed(spark, make_events):
    rows = [{"at": i, "actor_name": "root", "source_ip": f"10.0.0.{i}", "host": f"h{i}"} for i in range(14)]
    fs = [{"entity_key": "user:root", "evidence": [i]} for i in range(14)]
    found = run(spark, fs, make_events(rows))
    assert found.incidents.count() == 14
    assert {tuple(r.entity_keys) for r in found.incidents.collect()} == {("user:root",)}


def test_severity_follows_tactic_breadth(spark, make_events):
    ladder = spark.range(6).select(cor.escalate(F.lit(50), F.col("id")).alias("s")).orderBy("id").collect()
    assert [r.s for r in ladder] == [50, 50, 50, 70, 70, 90]
    # End to end: one incident for each number of tactics.
    scores = {0: 50, 2: 50, 3: 70, 4: 70, 5: 90}
    catalog = spark.createDataFrame(
        [(f"T{n}", "n", [f"t{i}" for i in range(n)], None, False, "") for n in scores], TECHNIQUE)
    events = make_events([{"host": f"h{n}", "source_ip": f"10.0.0.{n}", "actor_name": f"a{n}"} for n in scores])
    detection = build(spark, [
        {"entity_key": f"host:h{n}", "evidence": [i], "technique": f"T{n}"} for i, n in enumerate(scores)
    ], events)
    rows = cor.correlate(detection, events, catalog).incidents.collect()
    assert {r.tactic_count: r.severity_score for r in rows} == scores


def test_severity_stops_at_the_top(spark):
    got = spark.range(1).select(
        cor.escalate(F.lit(90), F.lit(9)).alias("a"), cor.escalate(F.lit(70), F.lit(5)).alias("b"),
        cor.escalate(F.lit(10), F.lit(0)).alias("c"),
    ).first()
    assert tuple(got) == (90, 90, 10)


def test_proposed_technique_changes_nothing(spark, make_events):
    events = make_events([{}])
    fs = [{"entity_key": "host:web1", "evidence": [0], "proposed": "T1098"}]
    row = run(spark, fs, events).incidents.first()
    assert row.tactics == [] and row.severity == "MEDIUM"


def test_untimed_findings_join_and_sort_last(spark, make_events):
    from trailhound.plans.incidents import timeline

    events = make_events([{"at": None}, {"at": 5}])
    fs = [
        {"entity_key": "host:web1", "evidence": [0]},
        {"entity_key": "host:web1", "evidence": [1], "rule": "s"},
    ]
    found = run(spark, fs, events)
    assert found.incidents.count() == 1
    lines = timeline(found, built_in_catalog(spark)).orderBy("timeline_position").collect()
    assert [r.span for r in lines] == ["04:41:05", "--:--:--"]


def test_input_order_does_not_change_ids(spark, make_events):
    events = make_events([{"at": i, "host": f"h{i % 3}"} for i in range(9)])
    fs = [{"entity_key": f"host:h{i % 3}", "evidence": [i], "rule": f"r{i}"} for i in range(9)]
    one = {r[0] for r in run(spark, fs, events).incidents.select("incident_id").collect()}
    two = {r[0] for r in run(spark, fs[::-1], events.orderBy(F.desc("event_id"))).incidents.select("incident_id").collect()}
    assert one == two


def test_many_copies_of_one_record_collapse_without_pairing(spark, make_events):
    """A third of all findings hold the same evidence hash; one survives."""
    copies = [{"at": 7, "source_event_id": str(i)} for i in range(300)]
    others = [{"at": 10 + i} for i in range(300)]
    fs = [{"entity_key": "host:web1", "evidence": [i]} for i in range(600)]
    found = run(spark, fs, make_events(copies + others))
    assert found.members.filter("kept").count() == 301


def test_copies_of_several_hashes_are_not_paired(spark):
    """20,000 findings over the same two hashes, and some over one of them: one survives."""
    members = spark.range(20_000).select(
        F.format_string("f%05d", "id").alias("finding_id"), F.lit("i").alias("incident_key"), F.lit("r").alias("rule_id"),
        F.when(F.col("id") < 19_000, 2).otherwise(1).cast("long").alias("evidence_count"), F.lit("host:web1").alias("entity_key"),
        F.lit(0).alias("rule_order"), F.col("id").alias("anchor_us"), F.col("id").alias("anchor_event"),
    )
    detail = members.select(
        "finding_id", F.explode(F.slice(F.array(F.md5(F.lit("a")), F.md5(F.lit("b"))), F.lit(1), F.col("evidence_count").cast("int"))).alias("evidence_hash")
    )
    left = members.join(cor.absorbed(members, detail), "finding_id", "left_anti").collect()
    assert [r.finding_id for r in left] == ["f00000"]


def test_findings_alone_of_their_rule_are_not_compared(spark, make_events, monkeypatch):
    """Evidence of findings that nothing can absorb is not written again, others' is."""
    rows = [{"at": i, "host": f"web{i % 20}", "actor_name": f"a{i % 20}", "source_ip": None} for i in range(200)]
    events = make_events(rows)
    alone = [{"entity_key": f"host:web{h}", "evidence": list(range(h, 200, 20))} for h in range(20)]
    both = [{"entity_key": "user:a0", "evidence": [0, 20]}]
    written = []
    keep = cor.materialize
    monkeypatch.setattr(cor, "materialize", lambda df: written.append(keep(df)) or written[-1])
    found = run(spark, alone, events)
    in_absorbed = [t for t in written if "ord" in t.columns or t.columns == ["finding_id", "evidence_hash"]]
    assert in_absorbed and all(t.isEmpty() for t in in_absorbed)
    assert found.members.filter("kept").count() == 20 and found.records.count() == 200
    found = run(spark, alone + both, events)
    assert found.members.filter("NOT kept").count() == 1 and found.records.count() == 200


def test_ambient_keys_are_written_and_broadcast(spark, make_events, monkeypatch):
    """Rows of evidence are not shuffled to find those of ambient keys: the table's size is known."""
    events = make_events([{"at": i, "source_ip": f"198.51.100.{i}", "actor_name": f"a{i}"} for i in range(20)])
    given = []
    keep = cor.joinable_keys
    monkeypatch.setattr(cor, "joinable_keys", lambda *args: given.append((args[2], keep(*args))) or given[-1][1])
    run(spark, [{"entity_key": "host:web1", "evidence": list(range(20))}, {"entity_key": "user:a3", "evidence": [3]}], events)
    noisy, keys = given[0]
    assert noisy.written_to and [r.entity_key for r in noisy.collect()] == ["host:web1"]
    assert {r.key for r in keys.collect()} == {f"{kind}{i}" for i in range(20) for kind in ("user:a", "ip:198.51.100.")}


def test_records_tell_raw_texts_apart(spark, make_events):
    """Equal evidence with two raw texts is two records, with the same text one."""
    same = {"at": 5, "source_event_id": None}
    events = make_events([same | {"raw": "a"}, same | {"raw": "b"}, same | {"raw": "b"}])
    found = run(spark, [{"entity_key": "host:web1", "evidence": [0, 1, 2]}], events)
    assert found.records.count() == 2
    assert {len(r.raw_hash) for r in found.records.collect()} == {cor.RAW_BYTES}


def test_evidence_is_written_before_findings_are_summed_up(spark, make_events):
    from trailhound.operators import library as lib
    from trailhound.operators.detect import detect, run_rule

    events = make_events([{"at": i} for i in range(12)])
    assert all(run_rule(rule, events)[1].written_to for rule in lib.DEFAULT_RULES)
    found = detect(events).materialized()
    assert found.evidence.count() == found.findings.agg(F.sum("evidence_count")).first()[0]


def test_records_and_ids_come_of_one_shuffle_of_the_evidence(spark, make_events):
    """Findings alone in their incident name it: evidence meets only the others, and ids are
    read from the table of the records, also where an incident is cut by a batch's end."""
    import pyarrow as pa

    events = make_events([{"at": i, "host": f"web{i % 4}", "actor_name": f"a{i % 4}", "source_ip": None} for i in range(20)])
    fs = [{"entity_key": f"host:web{h}", "evidence": list(range(h, 20, 4))} for h in range(4)]
    fs += [{"entity_key": "user:a1", "evidence": [1, 5]}, {"entity_key": "user:a2", "evidence": [2], "rule": "s"}]
    found = run(spark, fs, events)
    kept = cor.kept_records(found.members, found.detail)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(incident_key" in plan
    assert kept.count() == found.records.count() == 20
    assert found.records.join(found.incidents, "incident_key", "left_anti").isEmpty()

    rows = [("a", b"\1"), ("a", b"\2"), ("a", b"\2"), ("a", b"\3"), ("b", b"\3"), ("c", b"\1")]
    want = {
        key: "INC-" + hashlib.sha256("|".join(sorted({h.hex() for k, h in rows if k == key})).encode()).hexdigest()[:8]
        for key in "abc"
    }
    names = ["incident_key", "source_type", "evidence_hash", "raw_hash"]
    for size in (1, 2, 3, 4, 6):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array(["s"] * len(part)), *[pa.array([h for _, h in part])] * 2], names)
            for part in (rows[i:i + size] for i in range(0, len(rows), size))
        ]
        out = [row for batch in cor.digest_stream(8)(iter(batches)) for row in batch.to_pylist()]
        assert {r["incident_key"]: r["incident_id"] for r in out if r["incident_id"]} == want
        assert [(r["incident_key"], r["raw_hash"]) for r in out if not r["incident_id"]] == rows
