"""Host authentication logs carried over syslog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.functions.json_values import once
from trailhound.functions.text import blank_to_null, strip

SOURCE_TYPE = "syslog_sshd"

# Line header, message patterns (first match wins), month names.
HEADER = (
    r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([\w\-./]+)(?:\[(\d+)\])?:\s*(.*)$"
)
ADDRESS = r"([\d.a-fA-F:]+)(?:\s+port\s+(\d+))?"
FAILED_INVALID = rf"Failed password for invalid user (\S+) from {ADDRESS}"
FAILED = rf"Failed password for (\S+) from {ADDRESS}"
INVALID = rf"Invalid user (\S+) from {ADDRESS}"
ACCEPTED = rf"Accepted (password|publickey|keyboard-interactive) for (\S+) from {ADDRESS}"
#: Patterns in order, with the places of user, address, port and method in them.
MESSAGES = {
    1: (FAILED_INVALID, (1, 2, 3)), 2: (FAILED, (1, 2, 3)), 3: (INVALID, (1, 2, 3)), 4: (ACCEPTED, (2, 3, 4, 1)),
}
PHRASES = ("Failed password for ", "Invalid user ", "Accepted ")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def score() -> Column:
    """Aggregate over a file's sample lines: syslog shape, confirmed by the process name."""
    value = F.col("value")
    line = strip(value) != ""
    lines = F.count_if(line)
    headers = F.count_if(line & value.rlike(HEADER))
    named = F.count_if(line & (value.contains("sshd[") | value.contains("sshd:")))
    return F.when(
        headers > 0, F.least(F.lit(1.0), 0.4 * (headers / lines) + 0.6 * (named / lines))
    ).otherwise(0.0)


def syslog_time(month: Column, day: Column, clock: Column, year: int, zone: str) -> Column:
    """NULL for a date that does not exist; syslog carries neither year nor zone."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    number = F.nullif(F.array_position(names, month), F.lit(0)).cast("int")
    part = lambda i: F.substring(clock, i, 2).cast("int")
    return F.when(
        part(7) < 60,
        F.try_make_timestamp(
            F.lit(year), number, day.cast("int"), part(1), part(4), part(7).cast("decimal(16,6)"),
            F.lit(zone),
        ),
    )


def parse(lines: DataFrame, default_year: int, zone: str = "UTC") -> DataFrame:
    """One row per line with event columns.

    `emitted` marks events; `blank` lines are read but not skipped; `error` is set for an
    event whose date does not exist, which is kept without a time.
    """
    maybe = F.lit(False)
    for phrase in PHRASES:
        maybe = maybe | F.col("line").contains(phrase)
    # A stripped line begins with no line break, and no group holds one: so a break marks the
    # texts that a pattern matched, and parts the groups of the one match.
    groups = "".join(f"\n${i}" for i in range(1, 8))
    header = F.split(F.when(maybe, F.regexp_replace("line", HEADER, groups)), "\n", 8)
    headed = lines.select("file", "line_no", once(strip(F.col("value"))).alias("line")).select(
        "*", once(header).alias("header")
    )
    msg = F.when((F.size("header") == 8) & (F.get("header", F.lit(0)) == ""), F.get("header", F.lit(7)))
    for which, (pattern, order) in MESSAGES.items():
        found = "".join(f"\n${i}" for i in order)
        msg = F.regexp_replace(msg, rf"(?s)^(?!\n).*?{pattern}.*\z", f"\n{which}{found}\n")
    event = headed.select(
        "*", once(F.when(msg.startswith("\n"), F.split(msg, "\n"))).alias("found")
    )

    def group(i: int) -> Column:
        return F.get("found", F.lit(i))

    def head(i: int) -> Column:
        return F.when(F.col("found").isNotNull(), F.get("header", F.lit(i)))

    event = event.withColumns(
        {
            "which": group(1).cast("int"),
            "pid": blank_to_null(head(6)),
            "port": blank_to_null(group(4)),
            "ts": once(F.when(
                F.col("found").isNotNull(), syslog_time(head(1), head(2), head(3), default_year, zone)
            )),
        }
    )
    emitted = F.col("which").isNotNull()
    return event.select(
        "file", "line_no",
        emitted.alias("emitted"),
        (F.col("line") == "").alias("blank"),
        F.when(emitted & F.col("ts").isNull(), "bad timestamp").alias("error"),
        F.when(emitted & F.col("ts").isNull(), F.col("line")).alias("excerpt"),
        F.lit(SOURCE_TYPE).alias("source_type"),
        F.col("line").alias("raw"),
        F.when(
            F.col("pid").isNotNull() | F.col("port").isNotNull(),
            F.concat(F.coalesce("pid", F.lit("")), F.lit(":"), F.coalesce("port", F.lit(""))),
        ).alias("source_event_id"),
        "ts",
        F.lit("authentication").alias("category"),
        F.lit("login").alias("action"),
        F.when(F.col("which") == 4, "success").otherwise("failure").alias("outcome"),
        group(2).alias("actor_name"),
        F.lit("user").alias("actor_type"),
        group(3).alias("source_ip"),
        F.col("port").try_cast("int").alias("source_port"),
        head(4).alias("host"),
        F.lit("sshd").alias("target_resource"),
        F.col("which").isin(1, 3).alias("invalid_user"),
        F.create_map(
            F.lit("service"), head(5),
            F.lit("pid"), F.col("pid"),
            F.lit("auth_method"), F.when(F.col("which") == 4, group(5)),
        ).alias("extra"),
    )
