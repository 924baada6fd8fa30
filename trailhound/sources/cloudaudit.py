"""Cloud audit records: JSON bundles, lists, single objects or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.functions.json_values import once, with_json, with_odd_numbers
from trailhound.functions.labels import lookup
from trailhound.functions.text import blank_to_null, snake, strip
from trailhound.sources.lines import document_lines

SOURCE_TYPE = "aws_cloudtrail"

# Sample markers, actor kinds, event names, per-service categories.
MARKERS = ('"eventVersion"', '"userIdentity"', '"eventSource"', '"awsRegion"')
ACTOR_KINDS = {
    "IAMUser": "user",
    "Root": "user",
    "AssumedRole": "assumed_role",
    "AWSService": "service",
    "AWSAccount": "service",
}
EVENT_NAMES = {
    "ConsoleLogin": ("authentication", "login"),
    "AssumeRole": ("authentication", "assume_role"),
    "AssumeRoleWithSAML": ("authentication", "assume_role"),
    "AssumeRoleWithWebIdentity": ("authentication", "assume_role"),
    "GetSessionToken": ("authentication", "session_token_issue"),
    "GetFederationToken": ("authentication", "session_token_issue"),
    "GetCallerIdentity": ("iam", "caller_identity_get"),
    "CreateUser": ("iam", "user_create"),
    "DeleteUser": ("iam", "user_delete"),
    "CreateAccessKey": ("iam", "access_key_create"),
    "AttachUserPolicy": ("iam", "policy_attach"),
    "AttachRolePolicy": ("iam", "policy_attach"),
    "PutUserPolicy": ("iam", "policy_put"),
    "DeleteTrail": ("configuration", "trail_delete"),
    "StopLogging": ("configuration", "logging_stop"),
    "PutBucketPolicy": ("storage", "bucket_policy_put"),
    "PutBucketAcl": ("storage", "bucket_acl_put"),
    "AuthorizeSecurityGroupIngress": ("network", "sg_ingress_authorize"),
}
# No service may default to `authentication`: rules match that category by outcome alone.
SERVICE_CATEGORIES = {
    "iam.amazonaws.com": "iam",
    "s3.amazonaws.com": "storage",
    "ec2.amazonaws.com": "network",
    "cloudtrail.amazonaws.com": "configuration",
}
SERVICE_SUFFIX = ".amazonaws.com"
ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?\z"
)


def score() -> Column:
    """Aggregate over a file's sample lines: JSON start, then a quarter per known field."""
    value = F.col("value")
    first = F.min_by(
        F.substring(strip(value), 1, 1), F.when(strip(value) != "", F.col("line_no"))
    )
    hits = sum(F.max(value.contains(m).cast("int")) for m in MARKERS)
    return F.when(first.isin("{", "["), F.least(F.lit(0.95), 0.25 * hits)).otherwise(0.0)


# The rarer ISO forms: basic and week dates, any separator, basic times, hours alone.
OTHER_ISO_TIME = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
    r"(?:(?s:.)(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?)"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?\z"
)


def _other_iso_time(value: Column) -> Column:
    part = lambda i: F.regexp_extract(value, OTHER_ISO_TIME, i)
    digits = F.regexp_replace(part(1), "[-W]", "")
    year = digits.substr(1, 4).cast("int")
    week, day = digits.substr(5, 2).cast("int"), F.coalesce(F.try_to_number(digits.substr(7, 1), F.lit("9")).cast("int"), F.lit(1))
    # The first week is the one with January 4th.
    monday = F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))))
    of_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    in_week = day.between(1, 7) & (week >= 1) & (F.weekofyear(of_week) == week)
    plain = F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2))
    date = F.when(value.substr(1, 6).contains("W"), F.when(in_week, F.date_format(of_week, "yyyy-MM-dd"))).otherwise(plain)
    time = F.regexp_replace(F.regexp_replace(part(2), ":", ""), ",", ".")
    two = lambda at: F.when(F.length(time) > at, time.substr(at, 2)).otherwise("00")
    fraction = F.rpad(F.regexp_extract(time, r"[.](\d{1,6})", 1), 6, "0")
    zone = F.regexp_replace(F.regexp_replace(part(3), "Z", "+0000"), ":", "")
    offset = F.concat_ws(":", zone.substr(1, 3), F.when(F.length(zone) > 4, zone.substr(4, 2)).otherwise("00"),
                         F.when(F.length(zone) > 6, zone.substr(6, 2)))
    clock = F.concat(two(1), F.lit(":"), two(3), F.lit(":"), two(5), F.lit("."), fraction)
    return F.when(
        part(1) != "", F.try_to_timestamp(F.concat(date, F.lit(" "), clock, F.when(zone == "", "+00:00").otherwise(offset)))
    )


def iso_time(value: Column) -> Column:
    """An ISO date or time of any form that Python reads; anything else is NULL."""
    # As a lambda the rarer forms add no generated code, which would be too much to be compiled.
    other = F.get(F.transform(F.array(value), _other_iso_time), F.lit(0))
    return F.when(
        value.rlike(ISO_TIME), F.try_to_timestamp(F.replace(value, F.lit(","), F.lit(".")))
    ).when(value.rlike(OTHER_ISO_TIME), other)


def clean_ip(value: Column) -> Column:
    """Service names stand in the address field of calls the provider makes itself."""
    return F.when((value != "") & ~value.endswith(SERVICE_SUFFIX), value)


def event_category(name: Column, service: Column) -> Column:
    by_name = {k: v[0] for k, v in EVENT_NAMES.items()}
    return lookup(name, by_name, lookup(service, SERVICE_CATEGORIES, F.lit("other")))


def event_action(name: Column) -> Column:
    return lookup(name, {k: v[1] for k, v in EVENT_NAMES.items()}, snake(name))


def document_records(documents: DataFrame) -> DataFrame:
    """(file, line_no, v, odd, value, error): one row per record of whole-file JSON.

    A file that is no single JSON value is read again line by line.
    """
    whole = with_json(documents, F.col("content"), "root", "odd")
    kind = F.schema_of_variant("root")
    bundled = F.try_variant_get("root", "$.Records", "variant")
    list_of = F.coalesce(
        F.when(kind.startswith("ARRAY"), F.try_variant_get("root", "$", "array<variant>")),
        F.when(
            kind.startswith("OBJECT") & bundled.isNotNull(),
            F.coalesce(
                F.try_variant_get("root", "$.Records", "array<variant>"), _no_records(bundled), F.array(bundled)
            ),
        ),
        F.array("root"),
    )
    records = (
        whole.filter(F.col("root").isNotNull())
        .select("file", "odd", F.posexplode(list_of).alias("at", "v"))
        .select("file", (F.col("at") + 1).cast("long").alias("line_no"), "v", "odd")
    )
    records = of_values(records)
    fallback = line_records(document_lines(whole.filter(F.col("root").isNull()).select("file", "content")))
    return records.unionByName(fallback)


def of_values(records: DataFrame) -> DataFrame:
    """Values of a document's list as records."""
    return records.select(
        "file", "line_no", "v", "odd", with_odd_numbers(F.to_json("v"), F.col("odd")).alias("value"),
        F.lit(False).alias("blank"), F.when(~is_object(F.col("v")), "record is not an object").alias("error"),
    )


def _no_records(bundled: Column) -> Column:
    """What stands in place of records is walked like a list and holds none: the keys of an
    object, the characters of a text."""
    keys = F.map_keys(F.try_variant_get(bundled, "$", "map<string,variant>"))
    text = F.when(F.schema_of_variant(bundled) == "STRING", F.try_variant_get(bundled, "$", "string"))
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.transform(F.coalesce(keys, characters), lambda k: k.cast("variant"))


def line_records(lines: DataFrame) -> DataFrame:
    """One row per non-blank line that is an object or no JSON; other JSON values are dropped."""
    stripped = lines.select("file", "line_no", once(strip(F.col("value"))).alias("value"))
    parsed = with_json(stripped.filter(F.col("value") != ""), F.col("value"), "v", "odd")
    return parsed.filter(F.col("v").isNull() | is_object(F.col("v"))).select(
        "file", "line_no", "v", "odd", "value", F.lit(False).alias("blank"),
        F.when(F.col("v").isNull(), "invalid JSON").alias("error"),
    )


def is_object(v: Column) -> Column:
    """Only an object can be cast to a struct, of whatever fields."""
    return F.try_variant_get(v, "$", "struct<x: boolean>").isNotNull()


# Fields read from a record, by object. All of an object come from one cast: a path to a place
# that is not there costs an exception. What the type of decides something stays a variant.
RECORD = {
    **dict.fromkeys(
        ("userIdentity", "eventName", "eventSource", "eventTime", "sourceIPAddress", "requestParameters",
         "responseElements", "errorCode", "errorMessage"), "variant"),
    **dict.fromkeys(("eventID", "userAgent", "recipientAccountId", "awsRegion"), "string"),
}
IDENTITY = {"type": "variant", "sessionContext": "variant", "arn": "string", "principalId": "string", "userName": "string"}


def fields(part: str, names: dict[str, str]) -> Column:
    """Fields of an object as a struct, NULL where they are missing; NULL for any other value."""
    kind = ", ".join(f"`{name}`: {kind}" for name, kind in names.items())
    return F.try_variant_get(part, "$", f"struct<{kind}>")


def empty(part: Column) -> Column:
    """Whether a value is an empty string, list or object, zero or false."""
    return F.to_json(part).isin('""', "0", "0.0", "false", "[]", "{}")


def parse_records(records: DataFrame) -> DataFrame:
    """Records to event rows; a field of a type that cannot be read makes an error row."""
    part, shape = (lambda name: F.col(f"part_{name}")), (lambda name: F.col(f"shape_{name}"))

    def text(name: str) -> Column:
        return F.try_variant_get(part(name), "$", "string")

    def nothing(name: str) -> Column:
        return part(name).isNull() | F.is_variant_null(part(name))

    def falsy(name: str) -> Column:
        return nothing(name) | empty(part(name))

    def falsy_or_text(name: str) -> Column:
        return part(name).isNull() | shape(name).isin("STRING", "VOID") | empty(part(name))

    def no_collection(name: str) -> Column:
        return part(name).isNull() | ~shape(name).rlike("^(OBJECT|ARRAY)") | empty(part(name))

    def object_if_any(name: str, found: Column) -> Column:
        return part(name).isNull() | found.isNotNull() | empty(part(name))

    readable = (
        (nothing("identity") | F.col("who").isNotNull() | empty(part("identity")))
        & (part("name").isNull() | (shape("name") == "STRING"))
        & no_collection("service")
        & falsy_or_text("time")
        & falsy_or_text("address")
        & no_collection("identity_type")
        & object_if_any("context", F.col("context"))
        & object_if_any("attributes", F.col("attributes"))
        & (F.col("failed") | nothing("response") | F.col("response").isNotNull() | empty(part("response")))
    )
    parts = {
        "identity": "userIdentity", "name": "eventName", "service": "eventSource", "time": "eventTime",
        "address": "sourceIPAddress", "response": "responseElements", "code": "errorCode", "message": "errorMessage",
    }
    # Objects first, then kinds, then what is made of kinds: columns used several times stay
    # columns and are worked out once per record. Each generator also begins a method of its own
    # in the generated code, and only methods of some size are compiled by the JVM.
    staged = (
        records.withColumn("record", once(fields("v", RECORD)))
        .withColumn("who", once(fields("record.userIdentity", IDENTITY)))
        .withColumns({f"part_{name}": F.col("record")[field] for name, field in parts.items()})
        .withColumns({"part_identity_type": F.col("who.type"), "part_context": F.col("who.sessionContext")})
        .withColumn("context", fields("part_context", {"attributes": "variant"}))
        .withColumn("part_attributes", F.col("context.attributes"))
        .withColumn("attributes", fields("part_attributes", {"mfaAuthenticated": "string"}))
        .withColumn("response", fields("part_response", {"ConsoleLogin": "string"}))
        .withColumns({f"shape_{n}": F.schema_of_variant(part(n)) for n in ("name", "service", "time", "address", "identity_type")})
        .withColumn("failed", once(~falsy("code") | ~falsy("message")))
        .withColumn("_error", once(
            F.coalesce("error", F.when(~F.coalesce(readable, F.lit(False)), "malformed record"))
        ))
        .drop("error").withColumnRenamed("_error", "error")
        .withColumn("name", once(F.coalesce(text("name"), F.lit("unknown"))))
        .withColumns(
            {
                "service": F.coalesce(text("service"), F.lit("")),
                "time": text("time"),
                "address": text("address"),
                "console": blank_to_null(F.col("response.ConsoleLogin")),
                "arn": blank_to_null(F.col("who.arn")),
                "request_arn": fields("record.requestParameters", {"policyArn": "string"})["policyArn"],
            }
        )
    )
    emitted = F.col("error").isNull()
    rows = staged.select(
        "file", "line_no", emitted.alias("emitted"), "blank", "error",
        F.when(~emitted, F.col("value")).alias("excerpt"),
        F.lit(SOURCE_TYPE).alias("source_type"),
        with_odd_numbers(F.to_json("v"), F.col("odd")).alias("raw"),
        F.col("record.eventID").alias("source_event_id"),
        F.col("time").alias("ts"),
        event_category(F.col("name"), F.col("service")).alias("category"),
        event_action(F.col("name")).alias("action"),
        F.when(F.col("failed"), "failure")
        .when(F.col("console").isNotNull() & (F.col("console") != "Success"), "failure")
        .otherwise("success").alias("outcome"),
        F.coalesce(blank_to_null(F.col("who.userName")), "arn").alias("actor_name"),
        F.coalesce("arn", blank_to_null(F.col("who.principalId"))).alias("actor_id"),
        lookup(
            F.coalesce(text("identity_type"), F.lit("")), ACTOR_KINDS, F.lit("unknown")
        ).alias("actor_type"),
        clean_ip(F.col("address")).alias("source_ip"),
        F.col("record.userAgent").alias("user_agent"),
        F.col("record.recipientAccountId").alias("account"),
        F.when(F.col("service") != "", F.concat_ws(":", "service", "name"))
        .otherwise(F.col("name")).alias("target_resource"),
        F.col("request_arn").alias("policy_arn"),
        F.create_map(
            F.lit("aws_region"), F.col("record.awsRegion"),
            F.lit("event_id"), F.col("record.eventID"),
            F.lit("error_code"), text("code"),
            F.lit("error_message"), text("message"),
            F.lit("policy_arn"), F.col("request_arn"),
            F.lit("mfa_authenticated"), F.col("attributes.mfaAuthenticated"),
        ).alias("extra"),
    )
    # Last, when rows are narrow.
    return rows.withColumn("_ts", once(iso_time(F.col("ts")))).withColumn("ts", F.col("_ts")).drop("_ts")
