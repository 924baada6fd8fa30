"""Large documents cut into records, against a whole-file reader."""

from __future__ import annotations

import contextlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trailhound.functions.json_values import with_odd_numbers
from trailhound.sources.documents import COMMA, EDGE, NOTHING, Cutter, cut_documents, effect, file_heads, large_files
from trailhound.sources.ingest import ingest
from trailhound.sources.store import EventStore


@contextlib.contextmanager
def splits_of(spark, size):
    """Files are read in splits of so many bytes, many of them in one task."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind == 0:
        return rng.choice(["", "a", 'q"q', "b\\", "}", "{[,", "]}", "é ", '\\"', "x,y", "tail\\\\"])
    if kind in (1, 2):
        return rng.choice([0, -1.5, 1e20, True, False, None, 17])
    if kind < 6:
        return f"t{rng.randrange(100)}"
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", 'k"', "Records", "}{"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def texts():
    rng = random.Random(6)
    out = {}
    for i in range(5):
        items = [value(rng) if rng.random() < 0.3 else {"id": j, "v": value(rng)} for j in range(rng.randrange(6))]
        text = json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        out[f"list{i}"] = text + rng.choice(["", "\n", " \r\n\t"])
        members = [("Records", items)] + [(f"m{k}", value(rng)) for k in range(rng.randrange(3))]
        rng.shuffle(members)
        body = ",".join(f"{json.dumps(k)} :{json.dumps(v, indent=rng.choice([None, 2]))}" for k, v in members)
        out[f"bundle{i}"] = " {" + body + "}" + rng.choice(["", "\n\n"])
    out |= {
        "empty_list": "[ ]", "empty_bundle": '{"Records": [\n]}', "empty_object": "{}", "one": '{"eventName": "x", "a": [1, {"b": 2}, 3], "c": {}}',
        "twice": '{"Records": [1, 2], "x": [3, 4], "Records": [{"a": 1}, {"b": [5, 6]}]}', "escaped_key": '{"Rec\\u006frds": [{"a": 1}, 2]}',
        "text_records": '{"Records": "ab}"}', "object_records": '{"Records": {"a": [1, 2], "b": 2}}', "null_records": '{"a": [1,2], "Records": null}',
        "nested": '{"Other": {"Records": [1, 2]}, "x": 1}', "odd_numbers": '[NaN, {"a": -Infinity, "b": [Infinity, "NaN", 0.5]}]',
        "bad_comma": "[1,,2]", "bad_last": "[1,2,]", "bad_end": "[1,2", "bad_more": "[1,2] x", "bad_two": '{"Records": [1]} {"a": 1}',
        "bad_deep": '{"Records": [{"a": }, {"b": 1}]}', "bad_member": '{"Records": [1, 2], "x": }', "bad_tail": '{"Records": [1, 2],}',
        "bad_close": '{"Records": [1, 2}]', "bad_string": '[{"a": "b}, {"c": 1}]', "bad_brace": '{"Records": [{"a": 1}}]', "bad_outer": '{"Records": [1]',
        "scalar": '"a}b"', "text": "Jan 1 00:00:00 host sshd[1]: no {braces} here",
    }
    return out


def plain(text):
    """('list', values) | ('object', value) | ('broken',)."""
    try:
        whole = json.loads(text)
    except ValueError:
        return ("broken",)
    if isinstance(whole, list):
        return ("list", whole)
    if isinstance(whole, dict):
        return ("list", whole["Records"]) if isinstance(whole.get("Records"), list) else ("object", whole)
    return ("broken",)


#: Documents that are also read in very small splits.
SPLIT = ("bundle1", "list2", "twice", "odd_numbers", "bad_tail", "bad_outer")


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_cut_documents_are_those_of_a_whole_file_reader(spark, tmp_path, size):
    all_texts = {k: t for k, t in texts().items() if size > 64 or k in SPLIT}
    for name, text in all_texts.items():
        (tmp_path / f"{name} %.json").write_text(text, encoding="utf-8", newline="")
    with splits_of(spark, size):
        found = cut_documents(spark, large_files(spark, str(tmp_path), 1))
    name = F.regexp_extract(F.col("file"), r"([^/]+)%20%25\.json$", 1).alias("name")
    records = found.records.select(name, "line_no", with_odd_numbers(F.to_json("v"), F.col("odd")).alias("json")).collect()
    got = {}
    for r in sorted(records, key=lambda r: (r["name"], r["line_no"])):
        got.setdefault(r["name"], []).append((r["line_no"], r["json"]))
    objects = {r["name"]: r["content"] for r in found.objects.select(name, "content").collect()}
    broken = {r["name"] for r in found.broken.select(name).collect()}
    for key, text in all_texts.items():
        want = plain(text)
        if want[0] == "list":
            assert [n for n, _ in got.get(key, [])] == list(range(1, len(want[1]) + 1)), key
            assert json.dumps([json.loads(j) for _, j in got.get(key, [])], sort_keys=True) == json.dumps(want[1], sort_keys=True), key
        elif want[0] == "object":
            assert json.loads(objects[key]) == want[1], key
        else:
            # An object that never closes may be handed on whole; it is found broken there.
            assert key in broken or plain(objects.get(key, "")) == ("broken",), key
            assert key not in got, key


def test_effects_compose_and_cutting_keeps_every_character():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice('ab{}[],"\\ ') for _ in range(rng.randrange(1, 40)))
        text = text.replace("\\", "\\\\") if text.endswith("\\") else text
        cut = rng.randrange(len(text) + 1)
        if text[:cut].endswith("\\"):
            continue
        (o1, *d1), (o2, *d2), whole = effect(text[:cut]), effect(text[cut:]), effect(text)
        assert whole == (o1 ^ o2, d1[0] + d2[o1], d1[1] + d2[1 - o1])
    cutter = Cutter(0, 0, 2)
    cutter.head = EDGE
    found = list(cutter.add('{"a,b": [1, "]}", {"c": [2, 3]}], "d": 4')) + list(cutter.add('}'))
    assert found == [
        (0, 0, EDGE, NOTHING, '{"a,b": [1'), (0, 1, NOTHING, NOTHING, ' "]}"'), (0, 2, NOTHING, COMMA, ' {"c": [2, 3]}]'),
    ]
    assert "".join(cutter.held) == ' "d": 4}' and cutter.head == COMMA and cutter.depth == 0


def test_heads_end_at_their_bound_and_have_no_row_of_a_whole_line(spark, tmp_path):
    (tmp_path / "a.json").write_text("[" + ",".join('{"a": 1}' for _ in range(2000)) + "]")
    (tmp_path / "bb.log").write_text("Jan 1 00:00:01 h p: x\n" * 50)
    with splits_of(spark, 4000):
        rows = file_heads(spark, large_files(spark, str(tmp_path), 1), chars=40).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"][-6:], []).append((r["line_no"], r["value"]))
    assert len(by_file["a.json"]) == 1 and len(by_file["a.json"][0][1]) <= 40
    assert by_file["bb.log"][0] == (1, "Jan 1 00:00:01 h p: x")


def record(i, name="ConsoleLogin"):
    return {
        "eventVersion": "1.08", "userIdentity": {"type": "IAMUser", "userName": f"u{i % 7}"}, "eventSource": "signin.amazonaws.com",
        "eventTime": f"2024-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}Z", "eventName": name, "awsRegion": "us-east-1", "eventID": f"e{i}",
        "sourceIPAddress": "203.0.113.5", "requestParameters": {"limit": float("-inf")} if i == 3 else None,
    }


def test_ingest_gives_the_same_rows_however_documents_are_read(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "bundle.json").write_text(json.dumps({"Records": [record(i) for i in range(20)] + [7]}, indent=1))
    (logs / "list.json").write_text(json.dumps([record(i) for i in range(100, 110)]))
    (logs / "single.json").write_text(json.dumps(record(300)))
    (logs / "broken.json").write_text(json.dumps({"Records": [record(400), record(401)]}, indent=1)[:-3])
    (logs / "lines.json").write_text("\n".join(json.dumps(record(i)) for i in range(200, 210)))
    (logs / "auth.log").write_text("Aug  2 04:41:00 web1 sshd[7]: Failed password for root from 203.0.113.5 port 22 ssh2\n" * 3)
    (logs / "empty.log").write_text("")
    seen = []
    for name, bound in (("whole", 1 << 30), ("cut", 100)):
        store = EventStore(spark, str(tmp_path / name))
        with splits_of(spark, 1500):
            done = ingest(spark, f"{logs}/*", store, 2026, large_bytes=bound)
        seen.append((
            sorted(map(tuple, store.events().select("raw", "dedup_hash", "event_date", F.expr("event_id & 68719476735")).collect())),
            sorted(map(tuple, done.ingests.select("filename", "source_type", "lines_read", "events_emitted", "lines_skipped", "events_persisted").collect())),
            sorted(map(tuple, done.parse_errors.collect())), sorted(map(tuple, done.rejected.collect())),
        ))
    assert seen[0] == seen[1]
    raws = [r[0] for r in seen[0][0]]
    assert sum('"limit":-Infinity' in r for r in raws) == 1 and not any("0.5" in r for r in raws)
    assert len(raws) == 20 + 10 + 1 + 10 + 1


def test_blocks_stay_when_cores_change_between_the_reads(spark, tmp_path, monkeypatch):
    """Executors that come or go between the two reads must not move the blocks."""
    from trailhound.sources import documents

    (tmp_path / "a.json").write_text(json.dumps({"Records": [{"i": i, "t": "x" * (i % 90)} for i in range(4000)]}))
    keep, calls = documents.materialize, []

    def changing(df):
        out = keep(df)
        calls.append(out)
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        return out

    monkeypatch.setattr(documents, "materialize", changing)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = cut_documents(spark, large_files(spark, str(tmp_path), 1))
        lines = sorted(r.line_no for r in found.records.select("line_no").collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(calls) > 1 and lines == list(range(1, 4001)) and found.broken.isEmpty()
