from __future__ import annotations

from trailhound.sources.store import EventStore
from trailhound.streaming.follow import follow

LINE = "Aug  2 04:41:07 web1 sshd[{0}]: Failed password for root from 1.2.3.4 port 50 ssh2\n"


def test_only_new_files_are_loaded(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = EventStore(spark, str(tmp_path / "store"))

    def run():
        query = follow(spark, str(logs), store, str(tmp_path / "ckpt"), 2026)
        query.awaitTermination(120)
        assert query.exception() is None

    (logs / "a.log").write_text(LINE.format(1) + LINE.format(2))
    run()
    assert (store.events().count(), store.ingests().count()) == (2, 1)
    (logs / "b.log").write_text(LINE.format(2) + LINE.format(3))
    run()
    run()
    assert (store.events().count(), store.ingests().count()) == (3, 2)
