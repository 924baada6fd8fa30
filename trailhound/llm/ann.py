"""Approximate nearest neighbours by balanced posting lists.

Heads are vectors of a bounded sample, one for each cell of a balanced bisection. Every
distinct vector goes to the list of its nearest head and, where it lies near a boundary, to
those of further heads within `CLOSURE` of that distance, unless a head that it already has is
nearer to the new one than the vector is. Heads are searched by a graph of near heads that a
worker holds. A query takes the lists whose heads lie within `RATIO` of its nearest head's
distance (or of that list's own radius, if larger), and is held against all their vectors.

Equal vectors are one row of the index with their k + 1 smallest ids, which are all that a
query can return of them; equal queries are searched once. Lists that hold or are asked much
are dealt out in parts. A query that finds fewer than k is asked of all lists.

Fixed bounds, all parameters: SAMPLE_FLOATS numbers sampled and MAX_HEADS heads, which decide
cost and recall; every vector is indexed.

Cases: rows without vec_id and vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the commonest one (ties: the
smaller). Equal rows count once. A vec_id with several vectors is a row with each: asked with
it, and found by it. Equal distances go to the smaller vec_id. An empty table gives no rows;
columns besides the two are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trailhound.session import materialize

K = 10
LIST_ROWS = 512
MAX_HEADS = 8192
HEAD_SAMPLE = 16
SAMPLE_FLOATS = 1 << 23
#: Lists a vector may be in, and how much further than the nearest head the others may be.
REPLICAS = 4
CLOSURE = 0.1
RATIO = 1.09
#: Graph: links of a head, heads a search begins at, heads it expands to place a vector.
LINKS = 16
ENTRIES = 32
EXPAND = 24
#: Rows of a list held by one task, and queries asked of one part.
CELL_ROWS = 8192
CELL_QUERIES = 65536
#: Vectors searched at once, and pairs compared at once.
BATCH = 256
BLOCK_PAIRS = 1 << 21


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector, k1, k2 (128 bits that stand for the vector) of the rows that take part."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    good = rows.filter(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    common = sizes.first()
    good = good.filter(F.size("vector") == (common["n"] if common else 0))
    return good.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})


def classes(rows: DataFrame, k: int) -> DataFrame:
    """k1, k2, vector, ids: each distinct vector with its k + 1 smallest ids."""
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    return (
        rows.dropDuplicates(["vec_id", "k1", "k2"])
        .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
        .groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)


def balanced_cells(points: np.ndarray, count: int) -> list[np.ndarray]:
    """`count` index sets of nearly equal size, neighbours next to each other: each set is cut
    at the middle along the line between two means."""

    def cut(own: np.ndarray, parts: int) -> Iterator[np.ndarray]:
        if parts == 1:
            yield own
            return
        x = points[own]
        a, b = x[0], x[np.argmax(((x - x[0]) ** 2).sum(1))]
        for _ in range(4):
            side = x @ (b - a)
            low = side <= np.median(side)
            if low.all():
                break
            a, b = x[low].mean(0), x[~low].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        left = parts // 2
        at = len(own) * left // parts
        yield from cut(own[order[:at]], left)
        yield from cut(own[order[at:]], parts - left)

    return list(cut(np.arange(len(points)), count))


@dataclass
class Heads:
    """The heads, the graph over them, and what the sample says of their lists."""

    points: np.ndarray
    links: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    askers: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, total: int, asked: int, ratio: float) -> Heads:
        """From a sample of `total` vectors, of which `asked` are queries."""
        count = int(max(1, min(MAX_HEADS, total // LIST_ROWS, max(1, len(sample) // 4))))
        cells = balanced_cells(sample, count)
        points = np.stack([sample[c[np.argmin(((sample[c] - sample[c].mean(0)) ** 2).sum(1))]] for c in cells])
        radius = np.array([np.median(np.sqrt(((sample[c] - p) ** 2).sum(1))) for c, p in zip(cells, points)], dtype=np.float32)
        heads = cls(points, head_graph(points), radius, np.ones(count, np.int64), np.ones(count, np.int64))
        # How much lists hold and are asked decides in how many parts they are dealt out.
        row, leaf = heads.place(sample)
        held = np.bincount(leaf, minlength=count) * (total / len(sample))
        probe = sample[:: max(1, len(sample) // 512)]
        asks = np.bincount(heads.probe(probe, ratio)[1], minlength=count) * (asked / len(probe))
        heads.parts = np.maximum(1, np.ceil(held / CELL_ROWS)).astype(np.int64)
        heads.askers = np.maximum(1, np.ceil(asks / CELL_QUERIES)).astype(np.int64)
        return heads

    def _walk(self, x: np.ndarray, steps: int, ratio: float | None) -> np.ndarray:
        """Distances (rows, heads) that a search of the graph has met; infinite elsewhere."""
        count, rows = len(self.points), len(x)
        norm, own = (self.points * self.points).sum(1), (x * x).sum(1)
        met = np.full((rows, count), np.inf, dtype=np.float32)
        opened = np.zeros((rows, count), dtype=bool)
        begin = np.unique(np.linspace(0, count - 1, min(count, ENTRIES)).astype(int))
        met[:, begin] = np.sqrt(squared(x, self.points[begin]))
        live = np.arange(rows)
        for step in range(count if ratio is not None else min(steps, count)):
            open_ = np.where(opened[live], np.inf, met[live])
            best = open_.argmin(1)
            least = open_[np.arange(len(live)), best]
            go = np.isfinite(least)
            if ratio is not None:
                near = met[live].argmin(1)
                go &= least <= ratio * np.maximum(met[live, near], self.radius[near])
            live, best = live[go], best[go]
            if not len(live):
                break
            opened[live, best] = True
            to = self.links[best]
            d = norm[to] + own[live][:, None] - 2 * np.einsum("bd,bkd->bk", x[live], self.points[to])
            met[live[:, None], to] = np.sqrt(np.maximum(0, d))
        return met

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the home list of each vector and those behind near boundaries."""
        rows, lists = [], []
        for at in range(0, len(x), BATCH):
            part = x[at:at + BATCH]
            met = self._walk(part, EXPAND, None)
            wide = min(len(self.points), 4 * REPLICAS)
            order = np.argpartition(met, wide - 1, axis=1)[:, :wide]
            order = np.take_along_axis(order, np.take_along_axis(met, order, 1).argsort(1, kind="stable"), 1)
            d = np.take_along_axis(met, order, 1)
            taken = np.zeros(d.shape, dtype=bool)
            taken[:, 0] = True
            for c in range(1, wide):
                ok = (d[:, c] <= (1 + CLOSURE) * d[:, 0]) & (taken.sum(1) < REPLICAS)
                for s in range(c):
                    between = ((self.points[order[:, c]] - self.points[order[:, s]]) ** 2).sum(1)
                    ok &= ~(taken[:, s] & (between < d[:, c] ** 2))
                taken[:, c] = ok
            i, j = np.nonzero(taken)
            rows.append(at + i)
            lists.append(order[i, j])
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])

    def probe(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the lists a query asks; all of them with an infinite ratio."""
        if np.isinf(ratio):
            return np.repeat(np.arange(len(x)), len(self.points)), np.tile(np.arange(len(self.points)), len(x))
        rows, lists = [], []
        for at in range(0, len(x), BATCH):
            met = self._walk(x[at:at + BATCH], 0, ratio)
            near = met.argmin(1)
            bound = ratio * np.maximum(met[np.arange(len(near)), near], self.radius[near])
            i, j = np.nonzero(met <= bound[:, None])
            rows.append(at + i)
            lists.append(j)
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])


def head_graph(points: np.ndarray) -> np.ndarray:
    """(heads, links): near heads, of which none is nearer to an earlier one than to the head,
    filled up with the nearest; and both neighbours in the order of cells, which joins all."""
    count = len(points)
    links = np.empty((count, LINKS + 2), dtype=np.int64)
    wide = min(count - 1, 3 * LINKS)
    for i in range(count):
        links[i] = i
        links[i, LINKS:] = max(0, i - 1), min(count - 1, i + 1)
    for at in range(0, count if wide else 0, 1024):
        d = squared(points[at:at + 1024], points)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
        for i, own in enumerate(near):
            between = squared(points[own], points[own])
            chosen: list[int] = []
            for c in range(wide):
                if len(chosen) < LINKS and not any(between[c, s] < d[i, own[c]] for s in chosen):
                    chosen.append(c)
            chosen += [c for c in range(wide) if c not in chosen][: LINKS - len(chosen)]
            links[at + i, : len(chosen)] = own[chosen]
    return links


def nearest(asked: np.ndarray, held: np.ndarray, ids: list[list[int]], wanted: int) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """For each row of `asked` the `wanted` least (distance, id, index) among the vectors held."""
    step = max(1, BLOCK_PAIRS // max(1, len(held)))
    for at in range(0, len(asked), step):
        block = asked[at:at + step]
        rough = squared(block, held)
        slack = 1e-9 * (1 + rough.max(1))
        last = np.partition(rough, wanted - 1, axis=1)[:, wanted - 1] if len(held) > wanted else rough.max(1)
        for i, row in enumerate(rough):
            keep = np.nonzero(row <= last[i] + slack[i])[0]
            exact = np.sqrt(((held[keep] - block[i]) ** 2).sum(axis=1))
            found = sorted((d, n, j) for d, j in zip(exact.tolist(), keep.tolist()) for n in ids[j])
            yield at + i, found[:wanted]


SENT = "leaf int, part int, asker int, kind int, k1 long, k2 long, ids array<long>, vector array<{}>"


def _send(heads: Heads, kind: int, ratio: float):
    """Rows (k1, k2, ids, vector) to the lists they are held in (0) or asked of (1)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = matrix(some["vector"])
                row, leaf = heads.probe(x, ratio) if kind else heads.place(x)
                salt = some["k1"].to_numpy()[row]
                own, over = (heads.askers, heads.parts) if kind else (heads.parts, heads.askers)
                # Dealt out by its own number of parts, and copied to each of the other side's.
                times = over[leaf]
                row, leaf, salt = np.repeat(row, times), np.repeat(leaf, times), np.repeat(salt, times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = salt % own[leaf]
                part, asker = (other, mine) if kind else (mine, other)
                for cut in range(0, len(row), 8192):
                    pick = slice(cut, cut + 8192)
                    out = some.take(pa.array(row[pick]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[pick].astype(np.int32)) for a in (leaf, part, asker)]
                        + [pa.array(np.full(out.num_rows, kind, np.int32))]
                        + [out[c] for c in ("k1", "k2", "ids", "vector")],
                        ["leaf", "part", "asker", "kind", "k1", "k2", "ids", "vector"],
                    )

    return run


def _answer(wanted: int):
    """Over rows sorted by list, what it holds before what it is asked."""

    def run(batches):
        key, held, ids, marks, ready = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("leaf", "part", "asker", "kind")], axis=1)
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
                if begin == end:
                    continue
                some = batch.slice(begin, end - begin)
                if tuple(keys[begin, :3]) != key:
                    key, held, ids, marks, ready = tuple(keys[begin, :3]), [], [], [], None
                if keys[begin, 3] == 0:
                    held.append(matrix(some["vector"]))
                    ids += some["ids"].to_pylist()
                    marks += zip(some["k1"].to_pylist(), some["k2"].to_pylist())
                elif ids:
                    ready = np.concatenate(held) if ready is None else ready
                    k1, k2 = some["k1"].to_numpy(), some["k2"].to_numpy()
                    out = [(k1[i], k2[i], n, *marks[j], d) for i, found in nearest(matrix(some["vector"]), ready, ids, wanted) for d, n, j in found]
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], ["k1", "k2", "vec_id", "c1", "c2", "score"]
                    )

    return run


def _ask(index: DataFrame, queries: DataFrame, heads: Heads, k: int, ratio: float) -> DataFrame:
    """k1, k2, hits (score, vec_id, c1, c2) of each query that finds any: its k + 1 nearest rows."""
    kind = index.schema["vector"].dataType.elementType.simpleString()
    schema = SENT.format(kind)
    asks = queries.select("k1", "k2", F.array().cast("array<long>").alias("ids"), "vector")
    sent = index.select("k1", "k2", "ids", "vector").mapInArrow(_send(heads, 0, ratio), schema).unionByName(
        asks.mapInArrow(_send(heads, 1, ratio), schema)
    )
    found = (
        sent.repartition("leaf", "part", "asker").sortWithinPartitions("leaf", "part", "asker", "kind")
        .mapInArrow(_answer(k + 1), "k1 long, k2 long, vec_id long, c1 long, c2 long, score double")
    )
    best = Window.partitionBy("k1", "k2").orderBy("score", "vec_id", "c1", "c2")
    return (
        found.repartition("k1", "k2").groupBy("k1", "k2", "vec_id", "c1", "c2").agg(F.min("score").alias("score"))
        .withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "c1", "c2"))).alias("hits"))
    )


def nearest_neighbours(
    rows: DataFrame, queries: Column | str = "vec_id % 100 = 0", k: int = K, ratio: float = RATIO
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `queries` selects."""
    rows = usable(rows)
    index = materialize(classes(rows, k))
    total = index.count()
    asking = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "k1", "k2", "vector").dropDuplicates(["query_id", "k1", "k2"])
    distinct = materialize(asking.dropDuplicates(["k1", "k2"]).select("k1", "k2", "vector"))
    asked = distinct.count()
    dims = len(index.select("vector").first()[0]) if total else 1
    wanted = min(SAMPLE_FLOATS // dims, HEAD_SAMPLE * max(1, min(MAX_HEADS, total // LIST_ROWS)))
    # By hash, so about that many rows; the same ones on every run.
    share = int(min(1.0, wanted / max(1, total)) * (1 << 32))
    picked = index.filter(F.pmod(F.xxhash64(F.lit(2), "k1", "k2"), F.lit(1 << 32)) < share).select("k1", "vector").toArrow()
    sample = matrix(picked["vector"]) if picked.num_rows else matrix(index.select("vector").limit(1).toArrow()["vector"])
    if not len(sample):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    heads = Heads.build(sample[np.argsort(picked["k1"].to_numpy())] if picked.num_rows else sample, total, asked, ratio)
    found = materialize(_ask(index, distinct, heads, k, ratio))
    if total > 1 and not np.isinf(ratio):
        # All rows there are, where these are few; else the lists asked held too few.
        enough = min(k + 1, index.select(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("n")).first()["n"])
        few = distinct.join(found.filter(F.size("hits") >= enough).select("k1", "k2"), ["k1", "k2"], "left_anti")
        few = materialize(few)
        if few.count():
            again = _ask(index, few, heads, k, float("inf"))
            found = found.join(few.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(again)
    own = lambda h: (h["vec_id"] == F.col("query_id")) & (h["c1"] == F.col("k1")) & (h["c2"] == F.col("k2"))
    hits = F.slice(F.filter("hits", lambda h: ~own(h)), 1, k)
    return (
        asking.drop("vector").join(found, ["k1", "k2"])
        .select("query_id", F.posexplode(hits).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )
