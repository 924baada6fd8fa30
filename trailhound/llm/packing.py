"""Packing of tokenized documents into sequences of a fixed length.

Shortest-pack-first over the length histogram (Krell et al., Efficient Sequence Packing
without Cross-contamination, 2021): the histogram has at most one entry per length, so the
packing itself costs the driver a bounded amount whatever the number of documents. Patterns
are then joined back to documents by their rank among the pieces of their length.

Cases: a null text is an empty one and gives the single id that ends a document. Rows that
repeat are documents of their own. Texts of any length are cut into pieces of the sequence
length, of which only the last is shorter. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trailhound.llm.common import map_batches
from trailhound.llm.tokens import MemoEncoder, byte_bpe_path
from trailhound.session import materialize

SEQUENCE_TOKENS = 1024
END = (0).to_bytes(4, "little")


class _Cutter:
    """Tokens of each text, cut into pieces; `idx` numbers a task's pieces of equal length."""

    def __init__(self, path: str, cap: int):
        self.path, self.cap = path, cap

    def start(self):
        encoder, cap, step = MemoEncoder.of(self.path), self.cap, 4 * self.cap
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()

        def cut(rows: dict) -> dict:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "idx")}
            for doc_id, ids in zip(rows["doc_id"], encoder.encode(rows["text"])):
                ids += END
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    n = len(piece) // 4
                    out["doc_id"].append(doc_id)
                    out["start"].append(at // 4)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
                    out["part"].append(part)
                    out["idx"].append(seen[n])
                    seen[n] += 1
            return out

        return cut


def shortest_pack_first(histogram: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs). Longest lengths go first, each into the
    open packs that hold least; new packs open only when it fits into none."""
    groups: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, order, packs, lengths)
    full: list[tuple[tuple[int, ...], int]] = []
    order = 0

    def put(room: int, packs: int, lengths: tuple[int, ...]) -> None:
        nonlocal order
        if packs and room:
            heapq.heappush(groups, (-room, order, packs, lengths))
            order += 1
        elif packs:
            full.append((lengths, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and groups and -groups[0][0] >= length:
            room, _, packs, lengths = heapq.heappop(groups)
            used = min(left, packs)
            put(-room, packs - used, lengths)
            put(-room - length, used, (*lengths, length))
            left -= used
        each = cap // length
        put(cap - length * each, left // each, (length,) * each)
        put(cap - length * (left % each), int(left % each > 0), (length,) * (left % each))
    return full + [(lengths, packs) for _, _, packs, lengths in groups]


def slot_runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset in the sequence)."""
    runs, taken, sequence = [], Counter(), 0
    for lengths, packs in patterns:
        offset = 0
        for length in lengths:
            runs.append((length, taken[length], taken[length] + packs, sequence, offset))
            taken[length] += packs
            offset += length
        sequence += packs
    return runs


def pack(docs: DataFrame, cap: int = SEQUENCE_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _Cutter(tokenizer or byte_bpe_path(), cap),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, idx long",
    ))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Bounded: one row per length at most went to the driver, and patterns come of it alone.
    runs = spark.createDataFrame(
        slot_runs(shortest_pack_first(histogram, cap)),
        "length long, first long, end long, sequence long, offset long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("idx"))
    slot = F.broadcast(runs).alias("r")
    return ranked.alias("p").join(
        slot,
        (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.first")) & (F.col("p.rank") < F.col("r.end")),
    ).select(
        "doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("r.sequence") + F.col("p.rank") - F.col("r.first")).alias("sequence_id"), "offset",
    )
