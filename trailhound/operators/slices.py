"""Ordered per-group computations that never put a whole group in one task.

A plain `Window.partitionBy(key)` sorts all rows of a key in one task, and one
entity may hold a third of all rows. Here every group is cut into time slices.
Rows are shuffled by (group, slice); a small per-slice summary, combined on the
map side, is chained along the group; and the result of that chain is joined back
to give each slice what came before it. Results are exact: no slice is dropped
and nothing is approximated. The chain holds one row per non-empty slice, so its
size follows the covered time span, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailhound.session import discard, materialize

DEFAULT_SLICE_US = 60 * 1_000_000


def slice_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us))


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: dict[str, str],
    slice_col: str = "slice",
) -> DataFrame:
    """Running sums (current row included) of several columns along a group's order.

    `totals` maps a new column name to the column it sums.
    """
    keys = [*group, slice_col]
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = rows.groupBy(*keys).agg(
        *[F.sum(column).alias(f"_in_{name}") for name, column in totals.items()]
    ).select(
        *keys,
        *[
            F.coalesce(F.sum(f"_in_{name}").over(before), F.lit(0)).alias(f"_carry_{name}")
            for name in totals
        ],
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.join(carried, keys)
        .withColumns(
            {
                name: F.col(f"_carry_{name}") + F.sum(column).over(within)
                for name, column in totals.items()
            }
        )
        .drop(*[f"_carry_{name}" for name in totals])
    )


def previous_row(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    slice_col: str = "slice",
) -> DataFrame:
    """Values of the row just before, along a group's order; NULL for the first row.

    `values` maps a new column name to the column it reads.
    """
    keys = [*group, slice_col]
    picked = F.struct(*[F.col(column).alias(name) for name, column in values.items()])
    chain = Window.partitionBy(*group).orderBy(slice_col)
    last = (
        rows.groupBy(*keys)
        .agg(F.max_by(picked, F.struct(*order)).alias("_last"))
        .select(*keys, F.lag("_last").over(chain).alias("_carry"))
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.join(last, keys)
        .withColumn("_prev", F.coalesce(F.lag(picked).over(within), F.col("_carry")))
        .withColumns({name: F.col(f"_prev.{name}") for name in values})
        .drop("_prev", "_carry")
    )


def neighbour_times(
    rows: DataFrame, group: Sequence[str], us: str = "us", slice_col: str = "slice"
) -> DataFrame:
    """`prev_us` and `next_us`: times of the rows around each row of a group."""
    keys = [*group, slice_col]
    chain = Window.partitionBy(*group).orderBy(slice_col)
    edges = rows.groupBy(*keys).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi")).select(
        *keys,
        F.lag("_hi").over(chain).alias("_before"),
        F.lead("_lo").over(chain).alias("_after"),
    )
    within = Window.partitionBy(*keys).orderBy(us, "event_id")
    return (
        rows.join(edges, keys)
        .withColumn("prev_us", F.coalesce(F.lag(us).over(within), F.col("_before")))
        .withColumn("next_us", F.coalesce(F.lead(us).over(within), F.col("_after")))
        .drop("_before", "_after")
    )


def runs(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    flag: str,
    slice_col: str = "slice",
) -> DataFrame:
    """Maximal runs of consecutive flagged rows, named by the row that starts them.

    Keeps flagged rows only and adds `run` (the order columns of the starting row, as
    a struct) and `is_start`.
    """
    keys = [*group, slice_col]
    here = F.struct(*order)
    within = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_prev", F.lag(flag).over(within))
    per_slice = marked.groupBy(*keys).agg(
        F.min_by(flag, here).alias("_first_flag"),
        F.max_by(flag, here).alias("_last_flag"),
        F.min(here).alias("_first"),
        F.max(F.when(F.col(flag) & ~F.col("_prev"), here)).alias("_last_start"),
    )
    chain = Window.partitionBy(*group).orderBy(slice_col)
    carried = (
        per_slice.withColumn(
            "_open", F.coalesce(F.lag("_last_flag").over(chain), F.lit(False))
        )
        .withColumn(
            "_named",
            F.coalesce("_last_start", F.when(F.col("_first_flag") & ~F.col("_open"), F.col("_first"))),
        )
        .select(
            *keys,
            "_open",
            F.last("_named", ignorenulls=True)
            .over(chain.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry"),
        )
    )
    return (
        marked.join(carried, keys)
        .withColumn("is_start", F.col(flag) & ~F.coalesce("_prev", "_open"))
        .withColumn(
            "run",
            F.coalesce(
                F.last(F.when(F.col("is_start"), here), ignorenulls=True).over(
                    within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                F.col("_carry"),
            ),
        )
        .filter(F.col(flag))
        .drop("_prev", "_open", "_carry")
    )


def chained_entries(
    rows: DataFrame, group: Sequence[str], at: str, step: str, slice_col: str = "slice"
) -> DataFrame:
    """What each row is entered with, where a row's `step` maps each entry of the row before
    (0, 1, ...) to an entry of this one, and a group's first row has a constant step.

    Pointer doubling: in round k a row's step is composed with that of the row 2^k before, so a
    chain of n rows is settled after log2(n) rounds of joins by number, none of which puts a
    group in one task. A row whose composed step is constant is settled and joins no more.
    """
    numbered = running_totals(rows.withColumn("_one", F.lit(1)), group, [at], {"_number": "_one"}, slice_col)
    current, distance = materialize(numbered.select(*group, at, "_number", F.col(step).alias("_step"))), 1
    constant = F.array_min("_step") == F.array_max("_step")
    while not current.filter(~constant).isEmpty():
        earlier = current.select(*group, (F.col("_number") + distance).alias("_number"), F.col("_step").alias("_earlier"))
        composed = (
            current.filter(~constant).join(earlier, [*group, "_number"])
            .select(*group, at, "_number", F.expr("transform(_earlier, e -> _step[e])").alias("_step"))
        )
        before, current = current, materialize(current.filter(constant).unionByName(composed))
        discard(before)
        distance *= 2
    return current.select(*group, at, F.col("_step")[0].alias("entry"))
