"""Log text derived from the driver's tables, so that the parsers can run on them at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOST_FILES = 5
CLOUD_FILES = 3


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _address() -> Column:
    return F.concat_ws(".", F.lit("10.0"), F.col("user_id") % 4, F.col("k"))


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, value): one syslog line per event, some blank, odd or badly dated."""
    raw = _raw(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    user = F.concat(F.lit("u"), "user_id")
    clock = F.date_format("ts", "HH:mm:ss")
    month_day = F.concat_ws(" ", F.date_format("ts", "MMM"), F.lpad(F.date_format("ts", "d"), 2, " "))
    host = F.concat(F.lit("host"), F.col("user_id") % 7)
    pid = F.concat(F.lit("sshd["), F.col("event_id") % 9000 + 100, F.lit("]:"))
    port = F.concat(F.lit(" port "), F.col("event_id") % 50000 + 1024)
    origin = F.concat(user, F.lit(" from "), _address())

    def line(message: Column, date: Column = month_day, process: Column = pid) -> Column:
        return F.concat_ws(" ", date, clock, host, process, message)

    value = (
        F.when(
            (kind == "error") & (k % 6 == 0), line(F.concat(F.lit("Invalid user "), origin, port))
        )
        .when(
            (kind == "error") & (k % 3 == 0),
            line(F.concat(F.lit("Failed password for invalid user "), origin, port, F.lit(" ssh2"))),
        )
        .when(kind == "error", line(F.concat(F.lit("Failed password for "), origin, port, F.lit(" ssh2"))))
        .when(kind == "signup", line(F.concat(F.lit("Accepted publickey for "), origin, port, F.lit(" ssh2"))))
        .when(kind == "click", line(F.concat(F.lit("pam_unix(sshd:session): session opened for user "), user)))
        .when((kind == "view") & (k % 10 == 0), F.lit("  "))
        .when(kind == "view", line(F.lit("(root) CMD (run-parts /etc/cron.hourly)"), process=F.lit("CRON:")))
        .when(k % 4 == 0, F.concat(F.lit("no header here, Failed password for "), origin))
        .when(
            k % 4 == 1,
            line(F.concat(F.lit("Failed password for "), origin, port), date=F.lit("Feb 30")),
        )
        .otherwise(line(F.concat(F.lit("Failed password for "), origin), process=F.lit("sshd:")))
    )
    return raw.select(
        F.concat(F.lit("auth-"), F.col("event_id") % HOST_FILES).alias("file"),
        (F.floor(F.col("event_id") / HOST_FILES) + 1).alias("line_no"),
        value.alias("value"),
    )


def cloud_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, value): one audit record per event, some malformed in known ways."""
    raw = _raw(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    name = (
        F.when(kind == "click", "AttachUserPolicy").when(kind == "purchase", "CreateAccessKey")
        .when((kind == "view") & (k % 20 == 0), "StopLogging").when(kind == "view", "DescribeTrails")
        .otherwise("ConsoleLogin")
    )
    service = (
        F.when(kind.isin("click", "purchase"), "iam").when(kind == "view", "cloudtrail").otherwise("signin")
    )
    identity = F.when(k == 13, '"somebody"').otherwise(
        F.concat(
            F.lit('{"type":"'), F.when(k % 2 == 0, "IAMUser").otherwise("AssumedRole"),
            F.lit('","principalId":"P'), "user_id", F.lit('","arn":"'),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("arn:aws:iam::1:user/u"), "user_id")),
            F.lit('","userName":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")),
            F.lit('"}'),
        )
    )
    time = F.when(k == 31, "2024-99-01T00:00:00Z").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    )
    address = F.when(k == 19, "ec2.amazonaws.com").otherwise(_address())
    request = (
        F.when(k == 29, '"text"')
        .when(
            kind == "click",
            F.concat(
                F.lit('{"policyArn":"arn:aws:iam::aws:policy/'),
                F.when(k % 25 == 0, "AdministratorAccess").otherwise("ReadOnlyAccess"), F.lit('"}'),
            ),
        )
        .otherwise("null")
    )
    outcome = (
        F.when(kind == "signup", '"responseElements":{"ConsoleLogin":"Success"}')
        .when((kind == "error") & (k % 2 == 0), '"errorMessage":"Failed authentication"')
        .when(kind == "error", '"responseElements":{"ConsoleLogin":"Failure"}')
        .otherwise('"responseElements":null')
    )
    record = F.concat(
        F.lit('{"eventVersion":"1.08","userIdentity":'), identity, F.lit(',"eventTime":"'), time,
        F.lit('","eventSource":"'), service, F.lit('.amazonaws.com","eventName":"'), name,
        F.lit('","awsRegion":"us-east-1","sourceIPAddress":"'), address,
        F.lit('","requestParameters":'), request, F.lit(","), outcome,
        F.lit(',"eventID":"e'), "event_id", F.lit('","recipientAccountId":"'),
        F.lpad((F.col("user_id") % 3).cast("string"), 12, "1"), F.lit('"}'),
    )
    value = (
        F.when(k == 17, F.concat(F.lit('{"eventVersion":'), "event_id"))
        .when(k == 23, F.lit("42"))
        .otherwise(record)
    )
    return raw.select(
        F.concat(F.lit("cloud-"), F.col("event_id") % CLOUD_FILES).alias("file"),
        (F.floor(F.col("event_id") / CLOUD_FILES) + 1).alias("line_no"),
        value.alias("value"),
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, value): web pages, which no log format fits."""
    return (
        spark.read.parquet(f"{sf_dir}/pages.parquet")
        .select(
            F.concat(F.lit("page-"), "page_id").alias("file"),
            F.posexplode(F.split("html", "\n")).alias("at", "value"),
        )
        .select("file", (F.col("at") + 1).cast("long").alias("line_no"), "value")
    )


def technique_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A technique bundle with one object per part, in the shape `stix.read_bundle` gives."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = F.col("p_partkey") % 900 + 1000
    code = F.concat(
        F.lit("T"), number, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(".00"), F.col("p_size") % 9)).otherwise("")
    )
    other = F.struct(
        F.lit("other").alias("source_name"), F.lit("X1").alias("external_id"), F.lit("u").alias("url")
    )
    mine = F.struct(
        F.lit("mitre-attack").alias("source_name"), code.alias("external_id"),
        F.concat(F.lit("https://example.org/"), code).alias("url"),
    )

    def phase(chain: str, name: Column) -> Column:
        return F.struct(F.lit(chain).alias("kill_chain_name"), name.alias("phase_name"))

    tactics = F.array(*[F.lit(t) for t in ("discovery", "persistence", "impact", "collection")])
    return parts.select(
        F.lit("bundle--1").alias("id"), F.lit("2.0").alias("spec_version"),
        F.col("p_partkey").alias("at"),
        F.struct(
            F.when(F.col("p_size") % 10 == 9, "malware").otherwise("attack-pattern").alias("type"),
            F.col("p_name").alias("name"),
            (F.col("p_size") % 8 == 0).alias("revoked"),
            F.when(F.col("p_size") % 11 == 0, True).alias("x_mitre_deprecated"),
            F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("modified"),
            F.when(F.col("p_size") > 25, "3.2.0").otherwise("2.1.0").alias("x_mitre_attack_spec_version"),
            F.when(F.col("p_size") % 13 == 5, F.array(other)).otherwise(F.array(other, mine)).alias("external_references"),
            F.array(
                phase("mitre-attack", F.try_element_at(tactics, (F.col("p_partkey") % 4 + 1).cast("int"))),
                phase("elsewhere", F.lit("nothing")),
                phase("mitre-attack", F.try_element_at(tactics, (F.col("p_size") % 4 + 1).cast("int"))),
            ).alias("kill_chain_phases"),
        ).alias("o"),
    )
