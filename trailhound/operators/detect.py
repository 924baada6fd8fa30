"""Run rules over events and put their findings into one table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trailhound.operators.library import DEFAULT_RULES
from trailhound.operators.rules import (
    DistinctThresholdRule, Rule, SequenceRule, SingleEventRule, ThresholdRule, evaluate, window_text,
)
from trailhound.schema import METADATA
from trailhound.session import materialize


@dataclass(frozen=True)
class Detection:
    """findings: one row each; evidence: (finding_id, event_id, us), written per rule."""

    findings: DataFrame
    evidence: DataFrame
    rules: tuple[Rule, ...]

    def materialized(self) -> "Detection":
        """Write the findings once, too, so that later stages do not run the rules again."""
        return Detection(materialize(self.findings), self.evidence, self.rules)


def run_rule(rule: Rule, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, evidence) of one rule. Evidence is written once: findings are summed up from it."""
    fired, evidence = evaluate(rule, events)
    evidence = materialize(evidence)
    single = isinstance(rule, SingleEventRule)
    if single:  # one row each: nothing to gather
        seen = F.timestamp_micros("anchor_us")
        findings = fired.select(
            "*", seen.alias("first_seen"), seen.alias("last_seen"), F.lit(1).cast("long").alias("evidence_count")
        )
    else:
        spans = evidence.groupBy("finding_id").agg(
            F.timestamp_micros(F.min("us")).alias("first_seen"),
            F.timestamp_micros(F.max("us")).alias("last_seen"),
            F.count(F.lit(1)).alias("evidence_count"),
        )
        findings = fired.join(spans, "finding_id")
    fields: dict[str, object] = {}
    if isinstance(rule, SequenceRule):
        fields["leading_count"] = F.col("evidence_count") - 1
        fields["window"] = F.lit(window_text(rule.window_us))
    elif isinstance(rule, ThresholdRule):
        fields["count"] = F.col("evidence_count")
        fields["window"] = F.lit(window_text(rule.window_us))
    if isinstance(rule, DistinctThresholdRule):
        findings = findings.join(distinct_values(rule, events, evidence), "finding_id", "left")
        fields["distinct_count"] = F.size("values").cast("long")
        fields["distinct_values"] = F.col("values")
    if rule.extra_metadata and not single:
        anchors = events.filter(rule.scope()).select(
            F.col("event_id").alias("anchor_event"),
            *[c().alias(f"m_{name}") for name, c in rule.extra_metadata.items()],
        )
        findings = findings.join(anchors, "anchor_event", "left")
    for name in rule.extra_metadata:
        fields[name] = F.col(f"m_{name}")
    metadata = F.struct(
        *[
            (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in METADATA.fields
        ]
    )
    return (
        findings.select(
            "finding_id",
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.title).alias("title"),
            F.lit(rule.severity).alias("severity"),
            "entity_key",
            F.lit(rule.technique).cast("string").alias("technique"),
            F.lit(None).cast("string").alias("proposed_technique"),
            "first_seen", "last_seen", "evidence_count",
            metadata.alias("metadata"),
            "anchor_us", "anchor_event",
        ),
        evidence,
    )


def distinct_values(rule: DistinctThresholdRule, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Key values of each finding in the order they were first seen."""
    keyed = events.filter(rule.scope() & rule.matches()).select("event_id", rule.key().alias("value"))
    return (
        evidence.join(keyed, "event_id")
        .groupBy("finding_id", "value")
        .agg(F.min(F.struct("us", "event_id")).alias("seen"))
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("seen", "value"))).alias("vs"))
        .select("finding_id", F.col("vs.value").alias("values"))
    )


def detect(events: DataFrame, rules: Sequence[Rule] | None = None) -> Detection:
    """Findings of every rule; `rules` overrides the shipped list."""
    chosen = tuple(DEFAULT_RULES if rules is None else rules)
    if not chosen:
        raise ValueError("no rules to run")
    # Rules do not depend on each other, so their jobs share the cluster.
    with ThreadPoolExecutor(max_workers=len(chosen)) as pool:
        results = list(pool.map(lambda rule: run_rule(rule, events), chosen))
    findings = [f.withColumn("rule_order", F.lit(i)) for i, (f, _) in enumerate(results)]
    evidence = [e for _, e in results]
    return Detection(
        reduce(DataFrame.unionByName, findings), reduce(DataFrame.unionByName, evidence), chosen
    )


# The order in which findings are reported: entity, rule, time.
REPORT_ORDER = ("entity_key", "rule_order", "anchor_us", "anchor_event")


def findings_per_entity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("entity_key").agg(F.count(F.lit(1)).alias("findings"))


def detection_stats(events: DataFrame, detection: Detection) -> DataFrame:
    """One row saying what the pass did, so that an empty result can be explained."""
    seen = events.agg(
        F.count(F.lit(1)).alias("events_in"),
        F.count_if(F.col("ts").isNull()).alias("events_without_timestamp"),
    )
    entities = events.filter(F.col("ts").isNotNull()).select(
        F.explode("entity_keys").alias("k")
    ).agg(F.count_distinct("k").alias("entities"))
    found = detection.findings.agg(F.count(F.lit(1)).alias("findings"))
    one = F.lit(1).alias("one")
    return (
        seen.select("*", one)
        .join(entities.select("*", one), "one")
        .join(found.select("*", one), "one")
        .select(
            "events_in", "events_without_timestamp", "entities",
            F.lit(len(detection.rules)).alias("rules_run"), "findings",
        )
    )
