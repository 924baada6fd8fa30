"""SimHash near-duplicates by vantage-point trees.

Of two fingerprints that differ in at most r bits, one half differs in at most r // 2. So
there is a tree for each half, and its triangle bounds need only that smaller radius, which
leaves far fewer points near a boundary.

The top of a tree, built from a bounded sample of fingerprints, only says how to cut the
Hamming space into shards. Every distinct fingerprint goes to its home shard and, where the
triangle bound lets a partner lie across a boundary, also to the shards behind it; each shard
is then joined with what came to it, again by vantage points, and pairs are held against the
radius over all bits. All pairs are found whatever the sample was. A shard sends on only a
spanning forest of its links, so a dense group makes no quadratic output.

Cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; copies share one fingerprint, which is handled once; rows
that repeat stay. A null doc_id is never a component's name unless nothing else is there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import map_batches
from trailhound.operators.graph import connected_components
from trailhound.session import materialize

WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints a shard is home to, about, and rows of one cell of a shard.
SHARD_ROWS = 4096
CELL_ROWS = 16384
#: Fingerprints from which the top tree is built; it decides costs, never results.
SAMPLE = 4096
#: Pairs compared at once in a leaf.
BLOCK_PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [hash_of(b" ".join(tokens), SEED)]
    else:
        joined = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        hashes = [hash_of(s, SEED) for s in joined]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """doc_id, the key columns (longs), fp (the 64 bits as a signed long) for every row."""

    def work(rows: dict) -> dict:
        return {name: rows[name] for name in ("doc_id", *keys)} | {"fp": [fingerprint(t) for t in rows["text"]]}

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.col("text").cast("string").alias("text")),
        work, ", ".join(f"`{name}` long" for name in ("doc_id", *keys, "fp")),
    )


def half_of(points: np.ndarray, half: int) -> np.ndarray:
    """The lower (0) or upper (1) 32 bits."""
    return points >> np.uint64(32) if half else points & np.uint64(0xFFFFFFFF)


def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


@dataclass
class Node:
    vantage: int = 0
    within: int = -1
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


def _vantage(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """The point and median distance with the fewest points near the boundary; None if no
    point splits them."""
    best = None
    for at in np.linspace(0, len(points) - 1, min(len(points), 16)).astype(int):
        d = _distance(points, int(points[at]))
        within = int(np.sort(d)[(len(d) - 1) // 2])
        if within == d.max():
            within -= 1
        inside = np.count_nonzero(d <= within)
        if not 0 < inside < len(d):
            continue
        kept = np.count_nonzero(d <= within + radius) * inside + np.count_nonzero(d > within - radius) * (len(d) - inside)
        if best is None or kept < best[0]:
            best = (kept, int(points[at]), within)
    return best and best[1:]


def build_tree(points: np.ndarray, depth: int, radius: int) -> tuple[Node, int]:
    """A tree of at most `depth` levels over a sample, and its number of leaves."""
    leaves = 0

    def grow(own: np.ndarray, left: int) -> Node:
        nonlocal leaves
        cut = _vantage(own, radius) if left and len(own) > 1 else None
        if cut is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        vantage, within = cut
        inside = _distance(own, vantage) <= within
        return Node(vantage, within, grow(own[inside], left - 1), grow(own[~inside], left - 1))

    return grow(points, depth), leaves


def route(tree: Node, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the home leaf of each point and the later leaves it must ask."""
    rows, leaves, homes = [], [], []

    def down(node: Node, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if node.leaf >= 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), node.leaf))
            homes.append(home)
            return
        d = _distance(points[idx], node.vantage)
        inside = d <= node.within
        near, far = d <= node.within + radius, d > node.within - radius
        down(node.inner, idx[near], (home & inside)[near])
        down(node.outer, idx[far], (home & ~inside)[far])

    down(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    row, leaf, home = map(np.concatenate, (rows, leaves, homes))
    at = np.zeros(len(points), dtype=np.int64)
    at[row[home]] = leaf[home]
    keep = home | (leaf > at[row])  # of two homes, the later one sees the pair
    return row[keep], leaf[keep], home[keep]


def near_pairs(own: np.ndarray, other: np.ndarray, half: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (own, other) within the radius that are near in the given half, in blocks;
    branches that the triangle bound excludes are not compared."""
    own_half, other_half, bound = half_of(own, half), half_of(other, half), radius // 2
    stack = [(np.arange(len(own)), np.arange(len(other)))]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        cut = _vantage(own_half[a[:: max(1, len(a) // 256)]], bound) if len(a) > 64 and len(a) * len(b) > BLOCK_PAIRS else None
        if cut:
            vantage, within = cut
            da, db = _distance(own_half[a], vantage), _distance(other_half[b], vantage)
            inner, outer = db <= within + bound, db > within - bound
            if np.count_nonzero(inner) + np.count_nonzero(outer) < 1.95 * len(b):
                stack += [(a[da <= within], b[inner]), (a[da > within], b[outer])]
                continue
        step = max(1, BLOCK_PAIRS // len(b))
        for at in range(0, len(a), step):
            block = np.bitwise_count(own[a[at:at + step], None] ^ other[None, b]) <= radius
            i, j = np.nonzero(block)
            if len(i):
                yield a[at + i], b[j]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (i, j); a label is the least index of its group."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label = flat


def _cell_links(group: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    points = group["fp"].to_numpy().view(np.uint64)
    role = group["role"].to_numpy()
    own, other = np.nonzero(role != 1)[0], np.nonzero(role != 0)[0]
    label = np.arange(len(points))
    for i, j in near_pairs(points[own], points[other], int(group["half"].iloc[0]), radius):
        label = _hook(label, own[i], other[j])
    linked = np.nonzero(label != np.arange(len(points)))[0]
    fp = group["fp"].to_numpy()
    a, b = fp[linked], fp[label[linked]]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def links(distinct: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, per cell, of the fingerprints within the radius.

    `distinct` has the fingerprints as fp, each once.
    """
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD_ROWS))))
    points = np.array(sample, dtype=np.int64).view(np.uint64)
    trees = [build_tree(half_of(points, half), depth, radius // 2)[0] for half in (0, 1)]

    def send(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for at in range(0, len(fp), 4096):
                own = fp[at:at + 4096]
                for half, tree in enumerate(trees):
                    row, leaf, home = route(tree, half_of(own.view(np.uint64), half), radius // 2)
                    yield pd.DataFrame({"half": np.int32(half), "leaf": leaf.astype(np.int32), "fp": own[row], "home": home})

    sent = materialize(distinct.select("fp").mapInPandas(send, "half int, leaf int, fp long, home boolean"))
    # A shard of any size is met in cells of bounded size: part i of those at home against
    # part j of all that came. Most shards are one cell, whose rows have both roles (2).
    sizes = sent.groupBy("half", "leaf").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / CELL_ROWS).alias("kh"),
        F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("ko"),
    ).filter("kh > 0")
    h = F.pmod(F.xxhash64("fp"), F.col("kh"))
    o = F.pmod(F.xxhash64("fp"), F.col("ko"))
    as_own = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda j: F.struct(h.alias("i"), j.alias("j"), F.lit(0).alias("role")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("kh") - 1), lambda i: F.struct(i.alias("i"), o.alias("j"), F.lit(1).alias("role")))
    both = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.when(F.col("home"), 2).otherwise(1).alias("role")))
    cells = sent.join(F.broadcast(sizes), ["half", "leaf"]).select(  # a row per leaf of the bounded trees
        "half", "leaf", "fp",
        F.explode(
            F.when((F.col("kh") == 1) & (F.col("ko") == 1), both)
            .when(F.col("home"), F.concat(as_own, as_other)).otherwise(as_other)
        ).alias("c"),
    )
    return cells.select("half", "leaf", "fp", "c.i", "c.j", "c.role").groupBy("half", "leaf", "i", "j").applyInPandas(
        lambda pdf: _cell_links(pdf, radius), "a long, b long"
    )


def classes(docs: DataFrame, radius: int = RADIUS, keys: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the key columns, fp, class_fp (a fingerprint that stands
    for the component), component_id (least doc_id reachable)."""
    marked = materialize(fingerprints(docs, keys))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(materialize(links(distinct, distinct.count(), radius)))
    member = found.join(distinct.withColumnRenamed("fp", "node"), "node")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(named, "component").select(F.col("node").alias("fp"), F.col("component").alias("class_fp"), "component_id")
    # Written, so that a fingerprint with very many documents is a join that Spark can split.
    every = materialize(distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("class_fp", "fp").alias("class_fp"), F.coalesce("component_id", "least").alias("component_id")
    ))
    return marked.join(every, "fp").select("doc_id", *keys, "fp", "class_fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (least doc_id reachable)."""
    return classes(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
