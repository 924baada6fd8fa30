"""Attack-technique catalog: resolution, tactics, and audits of what maps to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trailhound.functions.text import normalize_technique

TECHNIQUE = T.StructType(
    [
        T.StructField("technique_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tactics", T.ArrayType(T.StringType())),
        T.StructField("parent_id", T.StringType()),
        T.StructField("deprecated", T.BooleanType()),
        T.StructField("url", T.StringType()),
    ]
)

# The techniques that rules and shortlists refer to, plus retired ones
# that must not resolve. Load a full catalog with `sources.stix` to replace it.
BUILT_IN = (
    ("T1046", "Network Service Discovery", ("discovery",), False),
    ("T1070", "Indicator Removal", ("stealth",), False),
    ("T1078", "Valid Accounts", ("stealth", "persistence", "privilege-escalation", "initial-access"), False),
    ("T1087", "Account Discovery", ("discovery",), False),
    ("T1098", "Account Manipulation", ("persistence", "privilege-escalation"), False),
    ("T1098.001", "Additional Cloud Credentials", ("persistence", "privilege-escalation"), False),
    ("T1110", "Brute Force", ("credential-access",), False),
    ("T1110.001", "Password Guessing", ("credential-access",), False),
    ("T1110.003", "Password Spraying", ("credential-access",), False),
    ("T1136", "Create Account", ("persistence",), False),
    ("T1530", "Data from Cloud Storage", ("collection",), False),
    ("T1537", "Transfer Data to Cloud Account", ("exfiltration",), False),
    ("T1548", "Abuse Elevation Control Mechanism", ("privilege-escalation",), False),
    ("T1562", "Impair Defenses", ("defense-evasion",), True),
    ("T1562.007", "Disable or Modify Cloud Firewall", ("defense-evasion",), True),
    ("T1562.008", "Disable or Modify Cloud Logs", ("defense-evasion",), True),
    ("T1580", "Cloud Infrastructure Discovery", ("discovery",), False),
    ("T1685", "Disable or Modify Tools", ("defense-impairment",), False),
    ("T1685.002", "Disable or Modify Cloud Log", (), False),
    ("T1686", "Disable or Modify System Firewall", ("defense-impairment",), False),
    ("T1686.001", "Cloud Firewall", ("defense-impairment",), False),
)

# Candidate techniques per event category, best first.
CANDIDATES = {
    "authentication": ("T1110", "T1110.001", "T1110.003", "T1078", "T1087"),
    "iam": ("T1098", "T1098.001", "T1136", "T1548"),
    "network": ("T1046", "T1580", "T1686.001"),
    "storage": ("T1530", "T1537"),
    "configuration": ("T1685", "T1685.002", "T1070"),
}


def built_in_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (tid, name, list(tactics), tid.split(".")[0] if "." in tid else None, retired,
         f"https://attack.mitre.org/techniques/{tid.replace('.', '/')}")
        for tid, name, tactics, retired in BUILT_IN
    ]
    return spark.createDataFrame(rows, TECHNIQUE)


def candidate_table(spark: SparkSession) -> DataFrame:
    rows = [
        (category, rank, tid)
        for category, ids in CANDIDATES.items()
        for rank, tid in enumerate(ids)
    ]
    return spark.createDataFrame(rows, "category string, rank int, technique_id string")


def resolvable(catalog: DataFrame) -> DataFrame:
    """Techniques that may be used, with the tactics they stand for.

    Retired ones are left out. One without tactics takes its parent's, even when the
    parent itself is retired.
    """
    parents = catalog.select(
        F.col("technique_id").alias("_parent"), F.col("tactics").alias("_parent_tactics")
    )
    own = F.coalesce("tactics", F.array().cast("array<string>"))
    inherited = F.coalesce("_parent_tactics", F.array().cast("array<string>"))
    return (
        catalog.filter(~F.coalesce("deprecated", F.lit(False)))
        .join(parents, normalize_technique(F.col("parent_id")) == F.col("_parent"), "left")
        .select(
            "technique_id", F.coalesce("name", F.lit("")).alias("name"),
            F.when(F.size(own) == 0, inherited).otherwise(own).alias("tactics"),
            "parent_id", F.coalesce("url", F.lit("")).alias("url"),
        )
    )


def resolve(rows: DataFrame, catalog: DataFrame, column: str = "technique") -> DataFrame:
    """Left join of technique facts; all NULL when the id must not be used."""
    facts = resolvable(catalog).select(
        F.col("technique_id").alias("resolved_id"), F.col("name").alias("technique_name"), "tactics"
    )
    return rows.join(facts, normalize_technique(F.col(column)) == F.col("resolved_id"), "left")


def mapping_both(catalog: DataFrame, one: str, other: str) -> DataFrame:
    """Techniques, retired ones included, whose own tactics contain both."""
    return catalog.filter(F.array_contains("tactics", one) & F.array_contains("tactics", other))


def unusable_mappings(spark: SparkSession, catalog: DataFrame, rules) -> DataFrame:
    """Rule and candidate techniques that do not resolve or give no tactic; must be empty."""
    mapped = spark.createDataFrame(
        [("rule", r.rule_id, r.technique) for r in rules if r.technique]
        + [("candidate", c, t) for c, ids in CANDIDATES.items() for t in ids],
        "origin string, owner string, technique_id string",
    )
    usable = resolvable(catalog).filter(F.size("tactics") > 0).select("technique_id")
    return mapped.join(usable, "technique_id", "left_anti").select("origin", "owner", "technique_id")


def validate_mappings(spark: SparkSession, catalog: DataFrame, rules) -> None:
    dead = unusable_mappings(spark, catalog, rules).collect()
    if dead:
        raise ValueError("techniques that do not resolve: " + ", ".join(
            f"{r.technique_id} ({r.origin} {r.owner})" for r in dead))
