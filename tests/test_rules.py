from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import models
from trailhound.functions.predicates import auth_failure, auth_success
from trailhound.operators import library as lib, rules, slices
from trailhound.operators.detect import detect, detection_stats, findings_per_entity, run_rule
from trailhound.operators.rules import (
    MINUTE, SECOND, DistinctThresholdRule, SequenceRule, SingleEventRule, ThresholdRule, window_text,
)


def evidence_lists(rule, events):
    """entity key -> sorted list of evidence id lists."""
    findings, evidence = run_rule(rule, events)
    rows = evidence.groupBy("finding_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    out = defaultdict(list)
    for r in findings.join(rows, "finding_id").collect():
        assert r.evidence_count == len(r.ids)
        out[r.entity_key].append(list(r.ids))
    return {k: sorted(v) for k, v in out.items()}


def random_events(seed, n=400, span=900, names=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(
            {
                "at": rnd.randrange(span),  # whole seconds: many ties
                "outcome": rnd.choice(["failure", "failure", "success"]),
                "actor_name": rnd.choice([f"u{j}" for j in range(names)] + [None, "U1"]),
                "source_ip": rnd.choice(["10.0.0.1", "10.0.0.2"]),
                "host": "h" if rnd.random() < 0.7 else "g",
                "invalid_user": rnd.random() < 0.5,
            }
        )
    return rows


def per_entity(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        keys = [f"ip:{r['source_ip']}", f"host:{r['host']}"]
        if r["actor_name"]:
            keys.append(f"user:{r['actor_name'].lower()}")
        for k in keys:
            groups[k].append((r["at"] * SECOND, i, r))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in groups.items()}


def test_long_unsettled_chains_are_entered_as_one_after_the_other(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for key, count in (("a", 700), ("b", 1), ("c", 37)):
        entry = 0
        for at in range(count):
            # Mostly permutations, which never settle a chain.
            step = [0, 0, 0] if at == 0 else rnd.sample(range(3), 3) if rnd.random() < 0.99 else [1, 1, 1]
            entry = step[entry]
            want[key, at * 3] = entry
            rows.append((key, at * 3, at * 3 // 50, step))
    df = spark.createDataFrame(rows, "k string, at long, slice long, step array<int>")
    got = {(r.k, r.at): r.entry for r in slices.chained_entries(df, ["k"], "at", "step").collect()}
    assert got == want


@pytest.mark.parametrize("seed,width,n,slice_s", [(1, 20, 5, 7), (2, 5, 3, 60), (3, 60, 12, 1), (4, 9, 1, 4)])
def test_threshold_matches_model(make_events, seed, width, n, slice_s):
    rows = random_events(seed)
    rule = replace(lib.BRUTE_FORCE, window_us=width * SECOND, threshold=n, slice_us=slice_s * SECOND)
    want = {}
    for key, group in per_entity(rows).items():
        hits = [(us, i) for us, i, r in group if r["outcome"] == "failure"]
        found = models.bursts(hits, width * SECOND, lambda inside: len(inside) >= n)
        if found:
            want[key] = sorted(found)
    assert evidence_lists(rule, make_events(rows)) == want


@pytest.mark.parametrize("seed,width,n,slice_s", [(5, 12, 3, 5), (6, 30, 4, 60), (7, 4, 2, 1)])
def test_distinct_threshold_matches_model(make_events, seed, width, n, slice_s):
    rows = random_events(seed, names=6)
    rule = replace(lib.INVALID_USERS, window_us=width * SECOND, threshold=n, slice_us=slice_s * SECOND)
    want = {}
    for key, group in per_entity(rows).items():
        hits = [
            (us, i, r["actor_name"].lower()) for us, i, r in group
            if r["outcome"] == "failure" and r["invalid_user"] and r["actor_name"]
        ]
        found = models.bursts(hits, width * SECOND, lambda inside: len({x[2] for x in inside}) >= n)
        if found:
            want[key] = sorted(found)
    assert evidence_lists(rule, make_events(rows)) == want


@pytest.mark.parametrize("seed,width,need,slice_s", [(8, 20, 1, 7), (9, 40, 2, 3), (10, 90, 5, 2), (11, 15, 3, 60)])
def test_sequence_matches_model(make_events, seed, width, need, slice_s):
    rows = random_events(seed)
    rule = replace(
        lib.BRUTE_FORCE_SUCCESS, window_us=width * SECOND, min_leading=need, slice_us=slice_s * SECOND
    )
    want = {}
    for key, group in per_entity(rows).items():
        flat = [(us, i, r["outcome"] == "failure", r["outcome"] == "success") for us, i, r in group]
        found = models.sequences(flat, width * SECOND, need)
        if found:
            want[key] = sorted(found)
    assert evidence_lists(rule, make_events(rows)) == want


@pytest.mark.parametrize("seed,need", [(12, 1), (13, 3)])
def test_sequence_with_overlapping_predicates(make_events, seed, need):
    """A row may be both kinds: when it fires it is no lead, otherwise it is one."""
    rows = random_events(seed, n=250)
    rule = SequenceRule(
        rule_id="overlap", title="t", severity=50, window_us=25 * SECOND, min_leading=need,
        slice_us=3 * SECOND, leading=lambda: F.col("invalid_user"), trailing=auth_success,
    )
    want = {}
    for key, group in per_entity(rows).items():
        flat = [(us, i, r["invalid_user"], r["outcome"] == "success") for us, i, r in group]
        found = models.sequences(flat, 25 * SECOND, need)
        if found:
            want[key] = sorted(found)
    assert evidence_lists(rule, make_events(rows)) == want


def test_alternating_rows_keep_their_phase_across_many_slices(make_events):
    """Lead, trail, lead, trail: every second trail fires, whatever the slice width."""
    rows = [{"at": i, "outcome": "failure" if i % 2 == 0 else "success"} for i in range(120)]
    for width in (1, 3, 500):
        rule = replace(
            lib.BRUTE_FORCE_SUCCESS, min_leading=2, window_us=30 * SECOND, slice_us=width * SECOND
        )
        assert evidence_lists(rule, make_events(rows))["host:web1"] == [
            [4 * j, 4 * j + 2, 4 * j + 3] for j in range(30)
        ]


def test_window_edge_is_inclusive(make_events):
    ats = [0, 1, 2, 3]
    assert evidence_lists(lib.BRUTE_FORCE, make_events([{"at": a} for a in ats + [600]]))["host:web1"] == [[0, 1, 2, 3, 4]]
    assert evidence_lists(lib.BRUTE_FORCE, make_events([{"at": a} for a in ats + [601]])) == {}


def test_two_bursts_far_apart(make_events):
    events = make_events([{"at": a} for a in list(range(5)) + list(range(5000, 5006))])
    assert [len(x) for x in evidence_lists(lib.BRUTE_FORCE, events)["user:root"]] == [5, 6]


def test_success_before_failures_is_nothing(make_events):
    rows = [{"outcome": "success"}] + [{}] * 6
    assert evidence_lists(lib.BRUTE_FORCE_SUCCESS, make_events(rows)) == {}


def test_distinct_names_in_metadata(make_events):
    names = ["Bob", "bob", "eve", "eve", "mal", "mal"]
    events = make_events([{"actor_name": n, "invalid_user": True} for n in names])
    row = run_rule(lib.INVALID_USERS, events)[0].filter("entity_key = 'host:web1'").first()
    assert (row.metadata["count"], row.metadata.distinct_count) == (6, 3)
    assert row.metadata.distinct_values == ["bob", "eve", "mal"]
    assert row.metadata.window == "0:10:00"


def test_single_event_rules(make_events):
    arn = "arn:aws:iam::aws:policy/{}"
    events = make_events(
        [
            {"category": "configuration", "action": "logging_stop", "target_resource": "t"},
            {"category": "iam", "action": "logging_stop"},
            {"category": "iam", "action": "policy_attach", "policy_arn": arn.format("AdministratorAccess")},
            {"category": "iam", "action": "policy_put", "policy_arn": arn.format("ReadOnlyAccess")},
            {"category": "iam", "action": "policy_put"},
        ]
    )
    logging = run_rule(lib.LOGGING_DISABLED, events)[0].collect()
    assert len(logging) == 3 and {r.anchor_event for r in logging} == {0}
    assert {(r.metadata.outcome, r.metadata.target) for r in logging} == {("failure", "t")}
    policy = run_rule(lib.ADMIN_POLICY, events)[0].collect()
    assert {r.metadata.policy_arn for r in policy} == {arn.format("AdministratorAccess")}


def test_untimed_events_are_left_out_and_counted(make_events):
    events = make_events([{"at": None}] * 3 + [{}] * 5)
    found = detect(events, [lib.BRUTE_FORCE])
    stats = detection_stats(events, found).first()
    assert (stats.events_in, stats.events_without_timestamp, stats.entities) == (8, 3, 3)
    assert (stats.rules_run, stats.findings) == (1, 3)
    assert {r.findings for r in findings_per_entity(found.findings).collect()} == {1}


def test_no_subscription_means_every_category(make_events):
    rule = SingleEventRule(rule_id="any", title="t", severity=10, matches=lambda: F.col("action") == "x")
    events = make_events([{"category": "storage", "action": "x"}, {"category": "other", "action": "x"}])
    assert run_rule(rule, events)[0].count() == 6


def test_finding_ids_do_not_change(make_events):
    rows = random_events(20)
    one = {r[0] for r in run_rule(lib.BRUTE_FORCE, make_events(rows))[0].select("finding_id").collect()}
    two = {
        r[0]
        for r in run_rule(replace(lib.BRUTE_FORCE, slice_us=SECOND), make_events(rows).repartition(7))[0]
        .select("finding_id").collect()
    }
    assert one == two


def test_window_text():
    assert window_text(10 * MINUTE) == "0:10:00"
    assert window_text(25 * 60 * MINUTE) == "1 day, 1:00:00"


def test_user_rule_kinds_are_distinguished():
    assert isinstance(lib.INVALID_USERS, DistinctThresholdRule) and isinstance(lib.INVALID_USERS, ThresholdRule)
    assert auth_failure is lib.BRUTE_FORCE.matches


def test_a_dense_minute_of_one_entity_is_no_special_case(spark):
    """60,000 alternating events of one host in one minute: every second one fires."""
    rows = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.lit("host:web1").alias("host"),
        F.timestamp_micros(F.lit(1_785_645_660_000_000) + F.col("id") * 900).alias("ts"),
        F.when(F.col("id") % 2 == 0, "authentication").otherwise("iam").alias("category"),
        F.when(F.col("id") % 2 == 0, "login").otherwise("access_key_create").alias("action"),
        F.when(F.col("id") % 2 == 0, "failure").otherwise("success").alias("outcome"),
        F.array(F.lit("host:web1")).alias("entity_keys"),
    )
    fired, evidence = rules.evaluate_sequence(lib.ACCESS_KEY, rows)
    assert fired.count() == 30_000 and evidence.count() == 60_000
