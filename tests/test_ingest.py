from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trailhound.functions.hashing import with_hashes
from trailhound.functions.json_values import odd_mark, strict_json, with_odd_numbers
from trailhound.functions.text import strip
from trailhound.schema import conform
from trailhound.session import materialize
from trailhound.sources import cloudaudit, hostlog
from trailhound.sources.formats import LogFormat, detect_formats
from trailhound.sources.ingest import ingest
from trailhound.sources.lines import read_lines
from trailhound.sources.store import EventStore


def as_lines(spark, *texts, file="f"):
    rows = [(file, i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, line_no long, value string")


def host(spark, *texts):
    return hostlog.parse(as_lines(spark, *texts), 2026).orderBy("line_no").collect()


HEAD = "Aug  2 04:41:07 web1 sshd[77]: "


def test_golden_fingerprint(spark):
    row = spark.createDataFrame(
        [("syslog_sshd", "1234:54321", "2026-08-02 04:41:07")], "source_type string, source_event_id string, t string"
    ).select(
        "source_type", "source_event_id", F.col("t").cast("timestamp").alias("ts"),
        F.lit("authentication").alias("category"), F.lit("login").alias("action"),
        F.lit("failure").alias("outcome"), F.lit("root").alias("actor_name"),
        F.lit("203.0.113.5").alias("source_ip"), F.lit("webserver01").alias("host"), F.lit("sshd").alias("target_resource"),
    )
    hashed = with_hashes(conform(row)).first()
    assert hashed.dedup_hash == "ad3a374f906f519a4796da7a22a697e1"
    assert hashed.evidence_hash != hashed.dedup_hash


def test_host_messages(spark):
    rows = host(
        spark,
        HEAD + "Failed password for root from 1.2.3.4 port 50 ssh2",
        HEAD + "Failed password for invalid user ann from 1.2.3.4 port 51",
        HEAD + "Invalid user bob from fe80::1 port 52",
        HEAD + "Accepted publickey for eve from 1.2.3.4 port 53 ssh2",
        "  " + HEAD + "Accepted keyboard-interactive for eve from 1.2.3.4  ",
    )
    assert [r.outcome for r in rows] == ["failure"] * 3 + ["success"] * 2
    assert [r.invalid_user for r in rows] == [False, True, True, False, False]
    assert [r.actor_name for r in rows] == ["root", "ann", "bob", "eve", "eve"]
    assert [r.source_event_id for r in rows] == ["77:50", "77:51", "77:52", "77:53", "77:"]
    assert rows[2].source_ip == "fe80::1" and rows[3].extra["auth_method"] == "publickey"
    assert str(rows[0].ts) == "2026-08-02 04:41:07" and rows[0].host == "web1"


def test_host_lines_that_are_no_events(spark):
    rows = host(spark, "", "free text", HEAD + "Connection closed", "Aug 2 04:41 web1 sshd: Invalid user a from 1.1.1.1")
    assert [(r.emitted, r.blank, r.error) for r in rows] == [
        (False, True, None), (False, False, None), (False, False, None), (False, False, None)
    ]


def test_impossible_dates_keep_the_event(spark):
    dates = ["Feb 30 04:41:07", "Xyz  1 04:41:07", "Aug  2 24:00:00", "Aug  2 04:41:60"]
    rows = host(spark, *[d + " web1 sshd: Failed password for root from 1.2.3.4" for d in dates])
    for row in rows:
        assert row.emitted and row.ts is None and row.error == "bad timestamp" and row.source_event_id is None


def test_zone_is_applied(spark):
    row = hostlog.parse(as_lines(spark, HEAD + "Invalid user a from 1.1.1.1"), 2026, "+02:00").first()
    assert str(row.ts) == "2026-08-02 02:41:07"


def record(**over):
    base = {
        "eventVersion": "1.08", "eventTime": "2026-08-02T04:45:30Z", "eventSource": "iam.amazonaws.com",
        "eventName": "CreateAccessKey", "awsRegion": "us-east-1", "sourceIPAddress": "1.2.3.4",
        "userIdentity": {"type": "IAMUser", "principalId": "P", "arn": "arn:x", "userName": "ann"},
        "eventID": "e1", "recipientAccountId": "111122223333", "requestParameters": None, "responseElements": None,
    }
    base.update(over)
    return {k: v for k, v in base.items() if v != "DROP"}


def cloud(spark, *records):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return cloudaudit.parse_records(cloudaudit.line_records(as_lines(spark, *texts))).orderBy("line_no").collect()


def test_cloud_fields(spark):
    row = cloud(spark, record())[0]
    assert (row.category, row.action, row.outcome) == ("iam", "access_key_create", "success")
    assert (row.actor_name, row.actor_id, row.actor_type) == ("ann", "arn:x", "user")
    assert (row.account, row.target_resource) == ("111122223333", "iam.amazonaws.com:CreateAccessKey")
    assert str(row.ts) == "2026-08-02 04:45:30" and row.source_event_id == "e1"
    assert list(json.loads(row.raw)) == sorted(json.loads(row.raw))


def test_cloud_outcomes(spark):
    login = {"eventName": "ConsoleLogin", "eventSource": "signin.amazonaws.com"}
    rows = cloud(
        spark,
        record(**login, responseElements={"ConsoleLogin": "Success"}),
        record(**login, responseElements={"ConsoleLogin": "Failure"}),
        record(**login, errorMessage="no", responseElements={"ConsoleLogin": "Success"}),
        record(errorCode="AccessDenied", responseElements="text"),
        record(errorCode="", errorMessage=None),
    )
    assert [r.outcome for r in rows] == ["success", "failure", "failure", "failure", "success"]


def test_unmapped_names_never_authenticate(spark):
    names = [("iam", "iam"), ("s3", "storage"), ("ec2", "network"), ("cloudtrail", "configuration"), ("sts", "other")]
    rows = cloud(spark, *[record(eventName="ListMFADevices", eventSource=f"{s}.amazonaws.com") for s, _ in names])
    assert [r.category for r in rows] == [c for _, c in names]
    assert {r.action for r in rows} == {"list_mfadevices"}
    assert cloud(spark, record(eventName="GetCallerIdentity", eventSource="sts.amazonaws.com"))[0].category == "iam"


def test_cloud_fallbacks(spark):
    rows = cloud(
        spark,
        record(userIdentity={"type": "Root", "arn": "arn:r", "userName": ""}),
        record(userIdentity={"principalId": "P9"}),
        record(userIdentity=None, eventName="DROP", eventSource="DROP"),
        record(sourceIPAddress="ec2.amazonaws.com", eventTime="2026-13-01T00:00:00Z"),
        record(eventTime="2026", requestParameters="text"),
        record(eventName="AttachUserPolicy", requestParameters={"policyArn": "arn:p"}),
    )
    assert [r.error for r in rows] == [None] * 6
    assert rows[0].actor_name == "arn:r" and rows[1].actor_id == "P9" and rows[1].actor_type == "unknown"
    assert (rows[2].action, rows[2].target_resource, rows[2].actor_name) == ("unknown", "unknown", None)
    assert rows[3].source_ip is None and rows[3].ts is None and rows[4].ts is None
    assert rows[5].policy_arn == "arn:p" and rows[4].policy_arn is None


def test_wrong_types_are_errors_not_nulls(spark):
    bad = [
        {"userIdentity": "x"}, {"userIdentity": ["x"]}, {"eventName": None}, {"eventName": 5},
        {"sourceIPAddress": 5}, {"eventTime": 5}, {"eventSource": ["x"]}, {"responseElements": "x"},
        {"userIdentity": {"sessionContext": None}}, {"userIdentity": {"sessionContext": {"attributes": 1}}},
        {"userIdentity": {"type": {"a": 1}}},
    ]
    rows = cloud(spark, *[record(**b) for b in bad])
    assert [(r.emitted, r.error) for r in rows] == [(False, "malformed record")] * len(bad)


def test_json_lines_drop_other_values_and_report_broken_ones(spark):
    rows = cloud(spark, record(), "42", "{broken", "[1]", "")
    assert [(r.line_no, r.error) for r in rows] == [(1, None), (3, "invalid JSON")]


def documents(spark, text):
    docs = spark.createDataFrame([("f", text)], "file string, content string")
    return cloudaudit.parse_records(cloudaudit.document_records(docs)).orderBy("line_no").collect()


def test_document_shapes(spark):
    one = record()
    assert [r.line_no for r in documents(spark, json.dumps({"Records": [one, one]}, indent=1))] == [1, 2]
    assert [r.error for r in documents(spark, json.dumps([one, 5, "x"]))] == [None] + ["record is not an object"] * 2
    assert [r.emitted for r in documents(spark, json.dumps(one, indent=2))] == [True]
    assert [r.emitted for r in documents(spark, json.dumps(one) + "\n\n" + json.dumps(one))] == [True, True]
    assert [r.error for r in documents(spark, json.dumps(one) + " trailing")] == ["invalid JSON"]
    assert [r.account for r in documents(spark, json.dumps(one)[:-1] + ', "recipientAccountId": "last"}')] == ["last"]
    assert [r.error for r in documents(spark, '"text"')] == ["record is not an object"]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(5000)) + "a\x0bb\n" + "tail"
    (tmp_path / "big.log").write_text(text)
    (tmp_path / "bad.log").write_bytes(b"ok \xff\xfe\nnext\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).withColumn("name", F.regexp_extract("file", "([^/]+)$", 1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = {r.line_no: r.value for r in rows if r.name == "big.log"}
    assert big == dict(enumerate(text.splitlines(), start=1))
    bad = {r.line_no: r.value for r in rows if r.name == "bad.log"}
    assert bad == dict(enumerate(b"ok \xff\xfe\nnext\n".decode("utf-8", errors="replace").splitlines(), start=1))


def test_format_detection(spark):
    lines = (
        as_lines(spark, *[HEAD + "x"] * 9 + ["free"], file="host")
        .unionByName(as_lines(spark, json.dumps(record()), json.dumps(record()), file="jsonl"))
        .unionByName(as_lines(spark, "", "{", '"eventVersion": 1, "awsRegion": 2}', file="doc"))
        .unionByName(as_lines(spark, '{"eventVersion": 1}', file="weak"))
        .unionByName(as_lines(spark, "hello", "world", file="text"))
        .unionByName(as_lines(spark, " ", "", file="blank"))
    )
    got = {r.file: r for r in detect_formats(lines).collect()}
    assert (got["host"].source_type, round(got["host"].confidence, 3)) == ("syslog_sshd", 0.9)
    assert (got["jsonl"].source_type, got["jsonl"].confidence, got["jsonl"].line_delimited) == ("aws_cloudtrail", 0.95, True)
    assert (got["doc"].source_type, got["doc"].confidence, got["doc"].line_delimited) == ("aws_cloudtrail", 0.5, False)
    assert (got["weak"].source_type, got["weak"].confidence) == (None, 0.25)
    assert (got["text"].source_type, got["blank"].confidence) == (None, 0.0)


def test_only_the_sample_is_scored(spark):
    lines = as_lines(spark, *["plain"] * 200 + [HEAD + "x"] * 50, file="late")
    assert detect_formats(lines).first().source_type is None


def test_own_format_and_tie_order(spark):
    always = LogFormat("mine", lambda: F.lit(0.0) * F.count(F.lit(1)) + 0.9, lambda lines, **_: lines)
    twin = LogFormat("twin", always.score, always.parse)
    assert detect_formats(as_lines(spark, "x"), [always, twin]).first().source_type == "mine"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("load")
    logs = tmp_path / "logs"
    logs.mkdir()
    line = HEAD + "Failed password for root from 1.2.3.4 port 50 ssh2"
    lines = [line] * 4 + [line.replace("port 50", f"port {p}") for p in (51, 52, 53)]
    lines += ["", "noise", "Feb 30 01:01:01 web1 sshd[1]: Invalid user a from 1.1.1.1 port 9"]
    (logs / "auth.log").write_text("\n".join(lines) + "\n")
    (logs / "trail.json").write_text(json.dumps({"Records": [record(), record(eventID="e2"), 7, record(userIdentity="x")]}))
    (logs / "lines.json").write_text("\n".join([json.dumps(record(eventID="e3")), "{bad", json.dumps(record())]))
    (logs / "notes.txt").write_text("nothing to see\n")
    (logs / "blank.txt").write_text("\n \n")
    (logs / "nothing.txt").write_bytes(b"")
    store = EventStore(spark, str(tmp_path / "store"))
    return str(logs), store, ingest(spark, logs_glob(logs), store, 2026)


def logs_glob(logs):
    return f"{logs}/*"


def by_file(rows, column="filename"):
    return {r[column].rsplit("/", 1)[1]: r for r in rows}


def test_ingest_counts(loaded):
    _, store, result = loaded
    runs = by_file(result.ingests.collect())
    auth, trail, lines = runs["auth.log"], runs["trail.json"], runs["lines.json"]
    assert (auth.lines_read, auth.events_emitted, auth.lines_skipped) == (10, 8, 2)
    assert (auth.events_persisted, auth.duplicates_skipped) == (5, 3)
    assert (trail.lines_read, trail.events_emitted, trail.lines_skipped) == (3, 2, 2)
    assert (lines.lines_read, lines.events_emitted, lines.lines_skipped) == (2, 2, 1)
    # e1 is in both cloud files; the file read first keeps it.
    assert trail.events_persisted + lines.events_persisted == 3
    assert store.events().count() == 8 and store.ingests().count() == 3


def test_ingest_errors_and_rejects(loaded):
    _, _, result = loaded
    errors = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.reason) for r in result.parse_errors.collect())
    assert errors == [
        ("auth.log", 10, "bad timestamp"), ("lines.json", 2, "invalid JSON"),
        ("trail.json", 3, "record is not an object"), ("trail.json", 4, "malformed record"),
    ]
    rejected = by_file(result.rejected.collect(), "file")
    assert set(rejected) == {"notes.txt", "blank.txt", "nothing.txt"}
    assert rejected["nothing.txt"].best_confidence == 0.0 and rejected["nothing.txt"].supported == "syslog_sshd, aws_cloudtrail"


def test_what_stands_for_records_is_walked_and_holds_none(spark):
    documents = [("o", '{"Records": {"eventName": "ConsoleLogin", "b": 1}}'), ("s", '{"Records": "ab"}'), ("n", '{"Records": [NaN]}')]
    rows = cloudaudit.parse_records(cloudaudit.document_records(
        spark.createDataFrame(documents, "file string, content string"))).orderBy("file", "line_no").collect()
    assert [(r.file, r.emitted, r.error) for r in rows] == [
        ("n", False, "record is not an object"), *[("o", False, "record is not an object")] * 2,
        *[("s", False, "record is not an object")] * 2]


def test_times_that_python_reads(spark):
    texts = ["20260802T044100Z", "2026-08-02T04", "2026-W31-7", "2026W317", "2026-W31", "2026-08-02T0441Z", "2026-08-02t04:41:00+00:00",
             "20260802", "2026-08-02 04:41:00.1234567", "2026-08-02T04:41:00,5-0330", "2026-W60-1", "2026-08", "2026-08-02T", "2026-08-02T4", "20260230"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cloudaudit.iso_time(F.col("t")).alias("ts")).collect()
    for row in got:
        try:
            want = dt.datetime.fromisoformat(row.t.replace("Z", "+00:00"))
            want = want.replace(tzinfo=want.tzinfo or dt.timezone.utc)
        except ValueError:
            want = None
        assert (row.ts and row.ts.astimezone(dt.timezone.utc)) == want, row.t


@pytest.mark.parametrize("text, value", [
    ("NaN", "NaN"), ('{"a": [-Infinity, "NaN", 0.5]}', '{"a":[-Infinity,"NaN",0.5]}'), ("NaNa", None), ('"Infinity"', '"Infinity"'),
    ('{"limit": Infinity, "b": ["-Infinity, NaN", -Infinity, NaN, -1]}', '{"b":["-Infinity, NaN",-Infinity,NaN,-1],"limit":Infinity}'),
])
def test_numbers_that_only_python_reads(spark, text, value):
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(with_odd_numbers(F.to_json(strict_json(t)), odd_mark(t)).alias("v")).first()
    assert row.v == value


def test_wide_blanks_are_stripped(spark):
    blank = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert spark.createDataFrame([(f"{blank}a b{blank}",)], "t string").select(strip(F.col("t")).alias("t")).first().t == "a b"


def test_loading_again_stores_nothing(spark, loaded):
    logs, store, _ = loaded
    before = store.events().orderBy("event_id").collect()
    again = ingest(spark, logs_glob(logs), store, 2026)
    assert {r.events_persisted for r in again.ingests.collect()} == {0}
    store.spark.catalog.refreshByPath(store.root)
    assert store.events().orderBy("event_id").collect() == before
    assert sorted(r.ingest_id for r in store.ingests().collect()) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("step", ["append_events", "append_ingests"])
def test_a_load_that_fails_is_as_if_it_had_not_been(spark, tmp_path, monkeypatch, step):
    logs = tmp_path / "logs"
    logs.mkdir()
    line = HEAD + "Failed password for root from 1.2.3.4 port 50 ssh2"
    (logs / "auth.log").write_text("\n".join([line, line.replace("port 50", "port 51"), "Feb 30 01:01:01 web1 sshd[1]: Invalid user a from 1.1.1.1 port 9"]))
    store = EventStore(spark, str(tmp_path / "store"))

    def fails(*_):
        raise OSError("no more room")

    with monkeypatch.context() as patch:
        patch.setattr(EventStore, step, fails)
        with pytest.raises(OSError):
            ingest(spark, logs_glob(logs), store, 2026)
    assert (store.events().count(), store.errors().count(), store.ingests().count(), store.last_ingest_id()) == (0, 0, 0, 0)
    done = ingest(spark, logs_glob(logs), store, 2026).ingests.first()
    assert (done.ingest_id, done.events_persisted, done.duplicates_skipped) == (1, 3, 0)
    assert (store.events().count(), store.events().select("dedup_hash").distinct().count()) == (3, 3)
    assert (store.errors().count(), store.ingests().count()) == (1, 1)
    assert "load" not in store.events().columns


def test_store_round_trip(loaded):
    _, store, result = loaded
    columns = [c for c in store.events().columns if c != "event_date"]
    stored = store.events().select(*columns).orderBy("event_id").collect()
    assert stored == result.fresh.select(*columns).orderBy("event_id").collect()
    assert store.events().filter("ts is null").count() == 1


def test_error_limit_and_excerpt(spark):
    from trailhound.sources.ingest import parse_errors

    rows = spark.range(1, 251).select(
        F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit("why").alias("error"),
        F.repeat(F.lit("x"), F.lit(500)).alias("excerpt"),
    )
    every = parse_errors(rows).collect()
    assert len(every) == 250 and {len(r.excerpt) for r in every} == {500}
    kept = parse_errors(rows, limit=100, excerpt_chars=200).collect()
    assert sorted(r.line_no for r in kept) == list(range(1, 101)) and {len(r.excerpt) for r in kept} == {200}


def test_rows_of_one_load_are_not_read_by_one_task(spark, make_events, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    for start in (0, 40):
        store.append_events(make_events([{"event_id": start + i, "at": i} for i in range(40)]))
    read = store.events()
    assert read.count() == 80
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_lines_are_spread_before_they_are_parsed(spark):
    """One file and one part of a table; filters on the text stay above the spreading."""
    from trailhound.plans.registry import spread

    lines = spark.range(0, 5000, 1, 1).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("value"))
    plan = spread(lines).filter(F.col("value").rlike("7$"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("RebalancePartitions")
    assert sorted(spread(lines).collect()) == sorted(lines.collect())


def test_generated_code_of_the_parsers_is_compiled(spark, tmp_path):
    """The JVM interprets methods over 8,000 bytes for good, which makes a record many times dearer."""
    path = str(tmp_path / "lines")
    as_lines(spark, "x").write.parquet(path)
    rows = spark.read.parquet(path)
    for parsed in (hostlog.parse(rows, 2026), cloudaudit.parse_records(cloudaudit.line_records(rows))):
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(parsed._jdf.queryExecution().executedPlan())
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
        assert sizes and max(sizes) < 8000


def test_text_is_not_shuffled_for_line_numbers(spark, tmp_path):
    """Lines are numbered over several blocks with no text in a shuffle, and events written once."""
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("".join(f"line {i} {'x' * 50}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    written = []
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr("trailhound.sources.lines.materialize", lambda df: written.append(df) or materialize(df))
            rows = read_lines(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.line_no, r.value.split()[1]) for r in rows] == [(i + 1, str(i)) for i in range(2000)]
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("value", [None, "", "text", 0, 5, 0.0, False, True, [], [1], {}, {"a": 1}])
def test_kinds_of_every_field(spark, value):
    """What the type of a field decides, for each kind of value, as Python's truth and types say."""
    falsy = not value
    text, object_ = falsy or isinstance(value, str), falsy or isinstance(value, dict)
    no_collection = not (isinstance(value, (list, dict)) and value)
    some = value is not None
    rows = {
        "userIdentity": object_, "eventName": isinstance(value, str), "eventSource": no_collection,
        "eventTime": text, "sourceIPAddress": text, "responseElements": object_, "requestParameters": True,
    }
    inner = {
        "type": no_collection, "sessionContext": some and object_,
    }
    lines = [record(**{name: value}) for name in rows] + [record(userIdentity={"userName": "u", name: value}) for name in inner]
    lines.append(record(userIdentity={"sessionContext": {"attributes": value}}))
    out = {r.line_no: r.error for r in cloudaudit.parse_records(cloudaudit.line_records(as_lines(spark, *map(json.dumps, lines)))).collect()}
    wanted = [*rows.values(), *inner.values(), some and object_]
    assert [out[i + 1] is None for i in range(len(lines))] == wanted
