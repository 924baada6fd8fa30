from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailhound.functions.entities import with_entity_keys  # noqa: E402
from trailhound.functions.hashing import with_hashes  # noqa: E402
from trailhound.schema import EVENT, conform  # noqa: E402
from trailhound.session import build_session  # noqa: E402

START = dt.datetime(2026, 8, 2, 4, 41, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", spark__sql__shuffle__partitions="2")


@pytest.fixture
def make_events(spark):
    """Events from dicts; `at` is seconds after START (None: no time)."""

    def make(rows):
        out = []
        for i, row in enumerate(rows):
            row = {
                "event_id": i, "source_type": "syslog_sshd", "raw": f"line {i}",
                "category": "authentication", "action": "login", "outcome": "failure",
                "actor_name": "root", "source_ip": "203.0.113.5", "host": "web1", "at": i, **row,
            }
            at = row.pop("at")
            row["ts"] = None if at is None else START + dt.timedelta(seconds=at)
            out.append(tuple(row.get(name) for name in EVENT.fieldNames()))
        return with_hashes(with_entity_keys(conform(spark.createDataFrame(out, EVENT))))

    return make
