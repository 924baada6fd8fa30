"""Content fingerprints of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.functions.text import iso_utc

# The hashed fields, in order. `raw` is left out on purpose.
HASHED_FIELDS = (
    "source_type", "source_event_id", "ts", "category", "action", "outcome",
    "actor_name", "source_ip", "host", "account", "target_resource",
)
HASH_CHARS = 32


def _fingerprint(parts: list[Column]) -> Column:
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *filled), 256), 1, HASH_CHARS)


def dedup_hash() -> Column:
    """Identity used by ingest: includes the source's own event id."""
    return _fingerprint(
        [iso_utc(F.col(f)) if f == "ts" else F.col(f) for f in HASHED_FIELDS]
    )


def evidence_hash() -> Column:
    """Identity after storage: the source event id is not kept, so its slot is empty."""
    return _fingerprint(
        [
            iso_utc(F.col(f)) if f == "ts"
            else F.lit("") if f == "source_event_id"
            else F.col(f)
            for f in HASHED_FIELDS
        ]
    )


def with_hashes(events: DataFrame) -> DataFrame:
    """Both identities, and the hash of the raw text, which later stages need without it."""
    return events.withColumns(
        {"dedup_hash": dedup_hash(), "evidence_hash": evidence_hash(), "raw_hash": F.sha2("raw", 256)}
    )
