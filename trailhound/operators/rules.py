"""Rule definitions and the four ways a rule fires.

A rule is a frozen description; its predicates return Column expressions, so the
optimizer sees them and pushes them to the scan. Each `evaluate_*` function turns
`events` into two narrow tables:

    fired     finding_id, entity_key, anchor_us, anchor_event
    evidence  finding_id, event_id, us

The anchor is the event that made the rule fire. It names the finding, so ids do not
depend on a global numbering and are the same after any retry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from trailhound.operators import slices
from trailhound.session import materialize

Predicate = Callable[[], Column]
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE

EXPLODE_BLOCK = 1 << 16
# Lead numbers, and so candidates at most, of a slice in which a sequence rule is resolved.
SLICE_LEADS = 512
#: Slices of an entity that one task links to those before them.
CHAIN_SLICES = 4096


@dataclass(frozen=True, kw_only=True)
class Rule:
    rule_id: str
    title: str
    severity: int
    technique: str | None = None
    subscribes_to: tuple[str, ...] = ()
    slice_us: int = slices.DEFAULT_SLICE_US
    # metadata field -> Column over the anchor event
    extra_metadata: dict[str, Predicate] = field(default_factory=dict)

    def scope(self) -> Column:
        """Category prefilter; an empty subscription means every category."""
        placed = F.col("ts").isNotNull()
        if not self.subscribes_to:
            return placed
        return placed & F.col("category").isin(*self.subscribes_to)


@dataclass(frozen=True, kw_only=True)
class SingleEventRule(Rule):
    matches: Predicate


@dataclass(frozen=True, kw_only=True)
class ThresholdRule(Rule):
    matches: Predicate
    window_us: int
    threshold: int


@dataclass(frozen=True, kw_only=True)
class DistinctThresholdRule(ThresholdRule):
    key: Predicate


@dataclass(frozen=True, kw_only=True)
class SequenceRule(Rule):
    leading: Predicate
    trailing: Predicate
    window_us: int
    min_leading: int = 1


def finding_id(rule_id: str, entity: Column, event: Column) -> Column:
    text = F.concat_ws("|", F.lit(rule_id), entity, event.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 32)


def window_text(window_us: int) -> str:
    seconds, _ = divmod(window_us, SECOND)
    hours, rest = divmod(seconds, 3600)
    days, hours = divmod(hours, 24)
    clock = f"{hours}:{rest // 60:02d}:{rest % 60:02d}"
    if not days:
        return clock
    return f"{days} day{'s' if days != 1 else ''}, {clock}"


def matching_rows(rule: Rule, events: DataFrame, condition: Column, **columns: Column) -> DataFrame:
    """Filter first, then fan out to entity keys: only matching rows are multiplied."""
    return events.filter(rule.scope() & condition).select(
        F.explode("entity_keys").alias("entity_key"),
        F.unix_micros("ts").alias("us"),
        "event_id",
        *[column.alias(name) for name, column in columns.items()],
    )


# -- single event -----------------------------------------------------------


def evaluate_single(rule: SingleEventRule, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every matching row is a finding of one row; metadata comes from that row, too."""
    extra = {f"m_{name}": c() for name, c in rule.extra_metadata.items()}
    hits = matching_rows(rule, events, rule.matches(), **extra).withColumn(
        "finding_id", finding_id(rule.rule_id, F.col("entity_key"), F.col("event_id"))
    )
    fired = hits.select(
        "finding_id", "entity_key", F.col("us").alias("anchor_us"),
        F.col("event_id").alias("anchor_event"), *extra,
    )
    return fired, hits.select("finding_id", "event_id", "us")


# -- sliding thresholds -----------------------------------------------------


def evaluate_threshold(rule: ThresholdRule, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At least N rows (or N distinct keys) in the trailing window, one finding per burst.

    The number of things inside the window is a running sum: +1 where a thing enters,
    -1 just after its last row leaves. For a plain threshold every row is a thing. For a
    distinct threshold a thing is a key value, which stays inside while its rows follow
    each other within the window. So no window content is ever collected.
    """
    window = rule.window_us
    if isinstance(rule, DistinctThresholdRule):
        rows = matching_rows(rule, events, rule.matches() & rule.key().isNotNull(), value=rule.key())
        rows = rows.withColumn("slice", slices.slice_of(F.col("us"), rule.slice_us))
        rows = slices.neighbour_times(rows, ["entity_key", "value"])
        enters = F.coalesce(F.col("us") - F.col("prev_us") > window, F.lit(True))
        leaves = F.coalesce(F.col("next_us") - F.col("us") > window, F.lit(True))
    else:
        rows = matching_rows(rule, events, rule.matches())
        enters = leaves = F.lit(True)

    def point(us: Column, kind: int, event: Column, delta: Column) -> Column:
        return F.struct(
            us.alias("us"), F.lit(kind).alias("kind"), event.alias("event_id"),
            delta.cast("long").alias("delta"),
        )

    arrival = point(F.col("us"), 0, F.col("event_id"), enters.cast("int"))
    expiry = point(F.col("us") + window, 1, F.lit(None).cast("long"), F.lit(-1))
    points = (
        rows.select(
            "entity_key",
            F.explode_outer(
                F.when(leaves, F.array(arrival, expiry)).otherwise(F.array(arrival))
            ).alias("p"),
        )
        .select("entity_key", "p.*")
        .withColumn("slice", slices.slice_of(F.col("us"), rule.slice_us))
    )
    counted = materialize(
        slices.running_totals(
            points, ["entity_key"], ["us", "kind", "event_id"], {"inside": "delta"}
        )
        .filter(F.col("kind") == 0)
        .select(
            "entity_key", "slice", "us", "event_id", (F.col("inside") >= rule.threshold).alias("hot")
        )
    )
    hot = materialize(
        slices.runs(counted, ["entity_key"], ["us", "event_id"], "hot")
        .withColumn("finding_id", finding_id(rule.rule_id, F.col("entity_key"), F.col("run.event_id")))
        .select("finding_id", "entity_key", "us", "event_id", "is_start")
    )

    starts = hot.filter("is_start")
    fired = starts.select(
        "finding_id", "entity_key", F.col("us").alias("anchor_us"),
        F.col("event_id").alias("anchor_event"),
    )
    # The first breach brings in what was already inside the window.
    reach = starts.select(
        "finding_id", "entity_key", F.col("us").alias("start_us"),
        F.col("event_id").alias("start_event"),
        F.explode(
            F.sequence(
                slices.slice_of(F.col("us") - window, rule.slice_us),
                slices.slice_of(F.col("us"), rule.slice_us),
            )
        ).alias("slice"),
    )
    lead_in = counted.join(reach, ["entity_key", "slice"]).filter(
        (F.col("us") >= F.col("start_us") - window)
        & (F.struct("us", "event_id") < F.struct("start_us", "start_event"))
    )
    evidence = hot.select("finding_id", "event_id", "us").unionByName(
        lead_in.select("finding_id", "event_id", "us")
    )
    return fired, evidence


# -- ordered sequences ------------------------------------------------------


def evaluate_sequence(rule: SequenceRule, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A trailing row fires on at least m leading rows inside the window since the last fire.

    Leading rows are numbered per entity. A trailing row that has l leads before it, m of
    them inside the window, is a candidate; it fires when l has grown by m since the
    previous fire. Of candidates with equal l only the first can fire.
    """
    window, need = rule.window_us, rule.min_leading
    leading = F.coalesce(rule.leading(), F.lit(False))
    trailing = F.coalesce(rule.trailing(), F.lit(False))
    rows = matching_rows(
        rule, events, leading | trailing, lead=leading.cast("long"), trail=trailing
    )

    def point(us: Column, kind: int, event: Column, inside: Column, lead: Column, trail: Column) -> Column:
        return F.struct(
            us.alias("us"), F.lit(kind).alias("kind"), event.alias("event_id"),
            inside.cast("long").alias("d_inside"), lead.cast("long").alias("lead"),
            trail.alias("trail"),
        )

    arrival = point(F.col("us"), 0, F.col("event_id"), F.col("lead"), F.col("lead"), F.col("trail"))
    expiry = point(
        F.col("us") + window, 1, F.lit(None).cast("long"), F.lit(-1), F.lit(0), F.lit(False)
    )
    points = (
        rows.select(
            "entity_key",
            F.explode_outer(
                F.when(F.col("lead") == 1, F.array(arrival, expiry)).otherwise(F.array(arrival))
            ).alias("p"),
        )
        .select("entity_key", "p.*")
        .withColumn("slice", slices.slice_of(F.col("us"), rule.slice_us))
    )
    numbered = materialize(
        slices.running_totals(
            points, ["entity_key"], ["us", "kind", "event_id"],
            {"inside": "d_inside", "leads": "lead"},
        ).filter(F.col("kind") == 0)
    )

    candidates = materialize(
        numbered.filter("trail")
        .select(
            "entity_key", "us", "event_id", "lead",
            (F.col("leads") - F.col("lead")).alias("n"),
            (F.col("inside") - F.col("lead")).alias("inside"),
        )
        .filter(F.col("inside") >= need)
        .groupBy("entity_key", "n")
        .agg(F.min(F.struct("us", "event_id", "lead", "inside")).alias("c"))
        .select("entity_key", "n", "c.*")
        # An entity's candidates differ in n and n grows with time, so a slice of lead numbers
        # is a stretch of time that holds a bounded number of candidates, however dense.
        .withColumn("slice", F.floor(F.col("n") / SLICE_LEADS))
    )
    fires = materialize(_greedy_fires(candidates, need))
    fires = materialize(
        slices.previous_row(
            fires.withColumn("end", F.col("n") + F.col("lead")),
            ["entity_key"], ["n"], {"prev_end": "end"},
        ).withColumn("finding_id", finding_id(rule.rule_id, F.col("entity_key"), F.col("event_id")))
    )

    fired = fires.select(
        "finding_id", "entity_key", F.col("us").alias("anchor_us"),
        F.col("event_id").alias("anchor_event"),
    )
    # A fire owns a contiguous run of lead numbers, so its evidence is an equi join.
    # The run is opened block by block: no array grows with the size of the burst.
    low = F.greatest(F.col("n") - F.col("inside"), F.coalesce("prev_end", F.lit(0))) + 1
    owned = (
        fires.select("finding_id", "entity_key", low.alias("low"), F.col("n").alias("high"))
        .withColumn(
            "block",
            F.explode(F.sequence(F.floor(F.col("low") / EXPLODE_BLOCK), F.floor(F.col("high") / EXPLODE_BLOCK))),
        )
        .select(
            "finding_id", "entity_key",
            F.explode(
                F.sequence(
                    F.greatest("low", F.col("block") * EXPLODE_BLOCK),
                    F.least("high", F.col("block") * EXPLODE_BLOCK + (EXPLODE_BLOCK - 1)),
                )
            ).alias("leads"),
        )
    )
    leads = numbered.filter(F.col("lead") == 1).select("entity_key", "leads", "event_id", "us")
    evidence = (
        owned.join(leads, ["entity_key", "leads"])
        .select("finding_id", "event_id", "us")
        .unionByName(fires.select("finding_id", "event_id", "us"))
    )
    return fired, evidence


def _greedy_fires(candidates: DataFrame, need: int) -> DataFrame:
    """Candidates taken greedily so that each has `need` new leads since the last one.

    What a slice passes on is one number, the lead count the next fire has to reach.
    Relative to the slice's first candidate there are only need + 1 different entries,
    so a slice is summarized by a vector of need + 1 exits, and what a slice is entered with
    follows from the vectors before it, composed in rounds (see `chained_entries`).
    """
    item = "struct(n, us, event_id, lead, inside)"
    packed = (
        candidates.groupBy("entity_key", "slice")
        .agg(F.expr(f"array_sort(collect_list({item}))").alias("items"))
        .withColumn("base", F.expr("items[0].n"))
        .withColumn(
            "exits",
            F.expr(
                f"""aggregate(items, transform(sequence(0, {need}), k -> base + k),
                    (goals, x) -> transform(goals,
                        g -> if(x.n >= g, x.n + x.lead + {need}L, g)))"""
            ),
        )
    )
    vectors = materialize(packed.select(
        "entity_key", F.col("slice").alias("at"), F.floor(F.col("slice") / CHAIN_SLICES).alias("slice"), "base", "exits"
    ))
    linked = slices.previous_row(vectors, ["entity_key"], ["at"], {"before": "exits"}).withColumn(
        # From an entry of the slice before to one of this slice; the first is entered with 0.
        "step",
        F.expr(f"transform(coalesce(before, transform(exits, g -> base)), g -> cast(greatest(0L, least({need}L, g - base)) as int))"),
    )
    entries = slices.chained_entries(linked, ["entity_key"], "at", "step").select(
        "entity_key", F.col("at").alias("slice"), "entry"
    )
    packed = packed.join(entries, ["entity_key", "slice"]).withColumn("goal", F.col("base") + F.col("entry"))
    return (
        packed.withColumn(
            "fires",
            F.expr(
                f"""aggregate(items,
                    struct(goal as goal, filter(items, x -> false) as out),
                    (acc, x) -> if(x.n >= acc.goal,
                        struct(x.n + x.lead + {need}L as goal, array_append(acc.out, x) as out),
                        acc),
                    acc -> acc.out)"""
            ),
        )
        .select("entity_key", "slice", F.explode("fires").alias("f"))
        .select("entity_key", "slice", "f.*")
    )


def evaluate(rule: Rule, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    if isinstance(rule, SequenceRule):
        return evaluate_sequence(rule, events)
    if isinstance(rule, ThresholdRule):
        return evaluate_threshold(rule, events)
    if isinstance(rule, SingleEventRule):
        return evaluate_single(rule, events)
    raise TypeError(f"unknown kind of rule: {type(rule).__name__}")
