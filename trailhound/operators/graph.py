"""Connected components by alternating star contraction.

Large-star / small-star (Kiveris et al., Connected Components in MapReduce and Beyond,
SoCC 2014). Only minima are aggregated, with map-side combining; no task ever holds the
neighbour list of a node. The edges of a node with very many of them are not shuffled to it:
such hubs are few (edges over degree), so their minima are sent to where the edges are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailhound.session import discard, materialize

MAX_ROUNDS = 100
#: Edges from which a node may be a hub, and how many hubs there may be.
HUB_EDGES = 1_000_000
MAX_HUBS = 100_000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Rows (u, v) with the `m` of their u. `least`: u, m, degree; `edges`: how many there are.

    A node is a hub if it has at least HUB_EDGES and a MAX_HUBS-th of all ends, so there are at
    most MAX_HUBS of them, which are broadcast; the others' rows are joined by shuffle."""
    bound = max(HUB_EDGES, 2 * edges // MAX_HUBS)
    if edges < bound:
        return rows.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.filter(F.col("degree") >= bound).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("degree") < bound).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("u", "m"))
    return (
        _with_least(both.filter(F.col("v") > F.col("u")), least, count)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return (
        _with_least(edges, least, count)
        .filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    pair = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = edges.agg(
        F.count(F.lit(1)), F.sum(pair), F.bit_xor(F.xxhash64("v", "u")), F.min("v"), F.max("u")
    ).first()
    return tuple(row)


def connected_components(
    edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Rounds grow with the logarithm of the longest chain; more than `max_rounds` is an error."""
    a, b = F.col(left), F.col(right)
    current = materialize(
        edges.filter(a != b)
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    loops = edges.filter(a == b).select(a.alias("node"))
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # The next round reads what this one wrote; the round before is not needed again.
        # The large star makes no more edges than there were.
        before, current = current, materialize(_small_star(_large_star(current, seen[0]), seen[0]))
        discard(before)
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("star contraction did not settle")
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(labels.select("node"), "node", "left_anti").select(
        "node", F.col("node").alias("component")
    )
    return labels.unionByName(roots).unionByName(alone).distinct()
