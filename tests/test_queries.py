from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_queries
from test_correlate import build
from trailhound.functions import labels, text
from trailhound.operators import catalog as cat
from trailhound.operators import correlate as cor
from trailhound.operators.library import DEFAULT_RULES
from trailhound.plans import incidents as inc, registry
from trailhound.plans import model_text as mt
from trailhound.sources import stix


@pytest.fixture(scope="module")
def catalog(spark):
    return cat.built_in_catalog(spark)


# -- reads ------------------------------------------------------------------


@pytest.fixture
def found(spark, make_events, catalog):
    rows = [{"at": i} for i in range(6)]
    rows += [{"at": 6, "outcome": "success", "source_type": "aws_cloudtrail"}]
    rows += [{"at": 90_000, "host": "db9", "source_ip": "198.51.100.7", "actor_name": "bak"}]
    events = make_events(rows)
    findings = [
        {"entity_key": "host:web1", "evidence": [0, 1, 2], "rule": "a", "severity": 70, "technique": "T1110"},
        {"entity_key": "ip:203.0.113.5", "evidence": [0, 1, 2, 6], "rule": "b", "severity": 90, "technique": "T1562.008"},
        {"entity_key": "host:db9", "evidence": [7], "rule": "c", "severity": 30, "technique": "T1098"},
    ]
    detection = build(spark, findings, events)
    return events, detection, cor.correlate(detection, events, catalog)


def test_queue_order_filter_and_search(found):
    queue = inc.incident_queue(found[2].incidents).collect()
    assert [r.severity for r in queue] == ["CRITICAL", "LOW"]
    assert tuple(queue[0].__fields__) == inc.QUEUE_COLUMNS
    assert inc.incident_queue(found[2].incidents, "LOW").count() == 1
    assert inc.incident_queue(found[2].incidents, "HIGH").count() == 0
    with pytest.raises(inc.UnknownSeverity):
        inc.incident_queue(found[2].incidents, "high")
    for needle, n in (("db9", 1), ("  PERSIST ", 1), ("cloudtrail", 1), ("syslog", 2), ("", 2), ("nothing", 0)):
        assert inc.search_queue(found[2].incidents, needle).count() == n, needle


def test_detail_and_missing_incident(found, catalog):
    worst = inc.incident_queue(found[2].incidents).first().incident_id
    row = inc.incident_detail(found[2], catalog, worst).first()
    assert row.enrichment_source == "deterministic"
    assert [(t.technique_id, t.tactics) for t in row.techniques] == [("T1110", ["credential-access"])]
    with pytest.raises(inc.UnknownIncident):
        inc.incident_detail(found[2], catalog, "INC-00000000")


def test_timeline_ends_in_order_and_keeps_dead_ids(found, catalog):
    worst = inc.incident_queue(found[2].incidents).first().incident_id
    rows = inc.incident_timeline(found[2], catalog, worst).collect()
    assert [(r.rule_id, r.technique_id, r.technique_name) for r in rows] == [
        ("a", "T1110", "Brute Force"), ("b", "T1562.008", None)
    ]
    assert rows[1].source_type == "syslog_sshd" and rows[0].span == "04:41:00-04:41:02"


def test_summary_text(found, catalog):
    text_of = {r.incident_id: r.summary for r in inc.summaries(found[2], catalog).collect()}
    low = inc.incident_queue(found[2].incidents, "LOW").first().incident_id
    assert text_of[low].splitlines() == [
        "host:db9 [LOW]: 1 finding, 2 tactics. First seen 2026-08-03 05:41:00, last at 05:41:00 (UTC; 0 seconds). "
        "One source bears it out: syslog_sshd. It shows persistence, privilege escalation. It touches host:db9.",
        "", "In order of time:", "  05:41:00  t [T1098 Account Manipulation] (1 event)",
    ]


def test_sources_counted_once_and_with_multiplicity(found):
    sources = {r.primary_entity: r.sources for r in found[2].incidents.collect()}
    assert [(s.source_type, s.event_count) for s in sources["ip:203.0.113.5"]] == [("syslog_sshd", 3), ("aws_cloudtrail", 1)]


# -- catalog ----------------------------------------------------------------


def test_shipped_mappings_resolve(spark, catalog):
    cat.validate_mappings(spark, catalog, DEFAULT_RULES)
    with pytest.raises(ValueError, match="T1110"):
        cat.validate_mappings(spark, catalog.filter("technique_id <> 'T1110'"), DEFAULT_RULES)


def test_parent_tactics(spark):
    rows = [
        ("T1", "p", ["a", "b"], None, True, ""), ("T1.1", "c", [], "t1", False, ""),
        ("T1.2", "c", ["z"], "T1", False, ""), ("T9.1", "orphan", None, "T9", False, ""),
        ("T2", "dead", ["a"], None, True, ""),
    ]
    got = {r.technique_id: r.tactics for r in cat.resolvable(spark.createDataFrame(rows, cat.TECHNIQUE)).collect()}
    assert got == {"T1.1": ["a", "b"], "T1.2": ["z"], "T9.1": []}


def test_stix_bundle(spark, tmp_path):
    def pattern(tid, **more):
        refs = [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": tid, "url": "u/" + tid}]
        phases = [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}, {"kill_chain_name": "x", "phase_name": "y"}]
        return {"type": "attack-pattern", "name": tid, "external_references": refs, "kill_chain_phases": phases, **more}

    bundle = {
        "id": "bundle--9", "spec_version": "2.0",
        "objects": [
            pattern("T2", revoked=True), pattern("T1.001", modified="2024-02-02", x_mitre_attack_spec_version="3.1"),
            pattern("T1", x_mitre_deprecated=False, modified="2025-01-01"), {"type": "malware"},
            {"type": "attack-pattern", "name": "no id"}, pattern("T1", name="later"),
        ],
    }
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps(bundle, indent=1))
    objects = stix.bundle_objects(stix.read_bundle(spark, str(path)))
    table = stix.techniques(objects)
    got = {r.technique_id: r for r in table.collect()}
    assert set(got) == {"T1", "T1.001", "T2"} and got["T1"].name == "later"
    assert got["T2"].deprecated and got["T1.001"].parent_id == "T1" and got["T1"].tactics == ["impact"]
    meta = stix.catalog_meta(objects, table).first()
    assert (meta.technique_count, meta.active_count, meta.deprecated_count, meta.subtechnique_count) == (3, 2, 1, 1)
    assert (meta.attack_spec_version, meta.content_last_modified, meta.bundle_id) == ("3.1", "2025-01-01", "bundle--9")
    stix.write_catalog(table, str(tmp_path / "cat"))
    assert stix.read_catalog(spark, str(tmp_path / "cat")).count() == 3
    with pytest.raises(ValueError):
        stix.write_catalog(table.filter("false"), str(tmp_path / "none"))


# -- scalar functions -------------------------------------------------------


def test_text_functions(spark):
    names = ["ConsoleLogin", "ListMFADevices", "already_snake", "A", "", "getÉtat"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in frame.select(text.snake(F.col("n"))).collect()]
    assert got == ["console_login", "list_mfadevices", "already_snake", "a", "", "get_état"]
    words = ["Straße", "ΣΑΣ", "ﬁn", "ADMIN", "ı"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in frame.select(text.casefold(F.col("w"))).collect()] == [w.casefold() for w in words]
    spaced = spark.createDataFrame([("\t x y \n",)], "s string")
    assert spaced.select(text.strip(F.col("s"))).first()[0] == "x y"


def test_duration_words(spark):
    def words(seconds):
        return spark.range(1).select(labels.duration_text(
            F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(seconds)))).first()[0]

    assert [words(s) for s in (0, 59, 60, 3599, 3600, 90_061)] == [
        "0 seconds", "59 seconds", "1 minutes", "59 minutes", "1h 0m", "25h 1m"
    ]


# -- model text -------------------------------------------------------------


def codes(spark, catalog, payloads, shortlist=("T1110",)):
    """Sorted failure codes of every payload, checked in one pass."""
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    outputs = spark.createDataFrame(
        [(f"i{n}", 1, t) for n, t in enumerate(texts)], "incident_key string, attempt int, raw_output string"
    )
    ids = [f"i{n}" for n in range(len(texts))]
    evidence = spark.createDataFrame([(i, "h1") for i in ids], "incident_key string, evidence_hash string")
    offered = None
    if shortlist is not None:
        offered = spark.createDataFrame(
            [(i, t) for i in ids for t in shortlist], "incident_key string, technique_id string"
        )
    got = {i: [] for i in ids}
    for r in mt.gate_failures(outputs, catalog, evidence, offered).collect():
        got[r.incident_key].append(r.code)
    return [sorted(got[i]) for i in ids]


OK = {"summary": "fine"}


GATE_CASES = [
    (OK, []), ("{", ["unparseable"]), ('{"summary":"x"} more', ["unparseable"]), ("[]", ["wrong_shape"]),
    ("null", ["wrong_shape"]), ({}, ["missing_summary"]), ({"summary": " \n"}, ["missing_summary"]),
    ({"summary": 5}, ["missing_summary"]), ({"summary": "s" * 1200}, []),
    ({"summary": "s" * 1201}, ["summary_too_long"]),
    ({**OK, "severity": 1, "x": 2}, ["forbidden_field", "unknown_field"]),
    ({**OK, "narrative": None, "playbook_id": None}, []), ({**OK, "narrative": []}, ["wrong_type"]),
    ({**OK, "narrative": "n" * 3001}, ["narrative_too_long"]),
    ({**OK, "proposed_techniques": None}, ["wrong_type"]), ({**OK, "proposed_techniques": {}}, ["wrong_type"]),
    ({**OK, "proposed_techniques": ["t1110"] * 6}, ["too_many_techniques"]),
    ({**OK, "proposed_techniques": [" t1110 ", 4]}, ["wrong_type"]),
    ({**OK, "proposed_techniques": ["T0", "T1098", "T1562.008"]}, ["off_list_technique", "unknown_technique", "unknown_technique"]),
    ({**OK, "playbook_id": "brute-force\n"}, ["malformed_playbook_id"]), ({**OK, "playbook_id": "abc"}, []),
    ({**OK, "playbook_id": "a" * 65}, ["malformed_playbook_id"]), ({**OK, "playbook_id": 1}, ["wrong_type"]),
    ({**OK, "recommended_actions": ["a"] * 11}, ["too_many_actions"]),
    ({**OK, "recommended_actions": ["a" * 301, None, "b" * 300]}, ["action_too_long", "wrong_type"]),
    ({**OK, "cited_events": ["h1", "h2", 3, None]}, ["ungrounded_citation"] * 3), ({**OK, "cited_events": "h9"}, []),
]


def test_gate(spark, catalog):
    got = codes(spark, catalog, [payload for payload, _ in GATE_CASES])
    assert list(zip(GATE_CASES, got)) == [(case, case[1]) for case in GATE_CASES]


def test_gate_without_and_with_empty_shortlist(spark, catalog):
    assert codes(spark, catalog, [{**OK, "proposed_techniques": ["T1078"]}], None) == [[]]
    assert codes(spark, catalog, [{**OK, "proposed_techniques": ["T1110"]}], ()) == [["off_list_technique"]]


def test_selection(spark, catalog):
    good, odd, bad = json.dumps(OK), "{", json.dumps({**OK, "severity": 1})
    tries = {
        "first": [good], "second": [odd, good], "both": [odd, odd], "final": [bad, good], "broken": [None, good],
        "none": [], "third": [odd, odd, good],
    }
    rows = [
        (k, i + 1, raw, "t" * 300 if raw is None else None) for k, raws in tries.items() for i, raw in enumerate(raws)
    ]
    outputs = spark.createDataFrame(rows, "incident_key string, attempt int, raw_output string, transport_error string")
    plain = spark.createDataFrame([(k, k, "plain") for k in tries], "incident_key string, incident_id string, summary string")
    nothing = spark.createDataFrame([], "incident_key string, evidence_hash string")
    failures = mt.gate_failures(outputs.filter("raw_output is not null"), catalog, nothing)
    got = {r.incident_id: r for r in mt.select_text(outputs, failures, plain).collect()}
    assert {k: (r.source, [f.code for f in r.failures]) for k, r in got.items()} == {
        "first": ("llm", []), "second": ("llm", ["unparseable"]), "both": ("deterministic", ["unparseable"] * 2),
        "final": ("deterministic", ["forbidden_field"]), "broken": ("deterministic", ["transport_error"]),
        "none": ("deterministic", []), "third": ("deterministic", ["unparseable"] * 2),
    }
    assert got["first"].summary == "fine" and got["both"].summary == "plain"
    assert len(got["broken"].failures[0].detail) == 200


def test_shortlist_takes_the_best_of_each_category_first(spark):
    rows = [("i", c) for c in ("iam", "authentication", "configuration", "other")]
    categories = spark.createDataFrame(rows, "incident_key string, category string")
    got = mt.shortlists(categories, cat.candidate_table(spark)).orderBy("place").collect()
    assert [r.technique_id for r in got] == [
        "T1110", "T1685", "T1098", "T1110.001", "T1685.002", "T1098.001", "T1110.003", "T1070"
    ]


# -- driver contract --------------------------------------------------------


def test_entry_and_contract(spark):
    assert set(registry.queries()) == set(oracle_queries.oracle_sql()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4
