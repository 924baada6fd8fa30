"""Display labels of tactics, sources, severities and spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Short tactic labels; anything else keeps its own name.
SHORT_TACTICS = {
    "collection": "collection",
    "command-and-control": "c2",
    "credential-access": "cred-access",
    "defense-impairment": "defense-imp",
    "discovery": "discovery",
    "execution": "execution",
    "exfiltration": "exfil",
    "impact": "impact",
    "initial-access": "init-access",
    "lateral-movement": "lateral-move",
    "persistence": "persist",
    "privilege-escalation": "privesc",
    "reconnaissance": "recon",
    "resource-development": "resource-dev",
    "stealth": "stealth",
}
# Which kind of system a source type describes.
SOURCE_KINDS = {"syslog_sshd": "host", "windows_security": "host", "aws_cloudtrail": "cloud"}
# Abbreviation and worst-first rank of each severity.
SEVERITY_ABBREV = {"CRITICAL": "CRIT", "HIGH": "HIGH", "MEDIUM": "MED", "LOW": "LOW", "INFO": "INFO"}
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def lookup(key: Column, table: dict, default: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def tactic_label(tactic: Column) -> Column:
    """credential-access -> credential access."""
    return F.replace(tactic, F.lit("-"), F.lit(" "))


def short_tactic(tactic: Column) -> Column:
    return lookup(tactic, SHORT_TACTICS, tactic)


def short_source(source: Column) -> Column:
    return F.regexp_replace(source, "^(syslog|aws|windows)_", "")


def source_kind(source: Column) -> Column:
    return lookup(source, SOURCE_KINDS, F.lit("other"))


def severity_abbrev(name: Column) -> Column:
    return lookup(name, SEVERITY_ABBREV, name)


def severity_rank(name: Column) -> Column:
    return lookup(name, SEVERITY_RANK, F.lit(len(SEVERITY_RANK)))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def span_text(first: Column, last: Column) -> Column:
    """One clock for an instant, two for a run, a placeholder for an unknown time."""
    return (
        F.when(first.isNull(), "--:--:--")
        .when(last.isNull() | (first == last), clock(first))
        .otherwise(F.concat_ws("-", clock(first), clock(last)))
    )


def duration_text(first: Column, last: Column) -> Column:
    seconds = F.expr("0L") + ((F.unix_micros(last) - F.unix_micros(first)) / 1_000_000).cast("long")
    minutes = F.floor(seconds / 60)
    return (
        F.when(first.isNull() | last.isNull(), "an unknown period")
        .when(seconds < 60, F.format_string("%d seconds", seconds))
        .when(seconds < 3600, F.format_string("%d minutes", minutes))
        .otherwise(
            F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor((seconds % 3600) / 60))
        )
    )


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)
