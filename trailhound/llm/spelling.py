"""Spelling variants by k-d trees over letter counts.

Words one edit apart differ by at most two in the sum of their letter counts' differences (by
one, if their lengths differ). For each length there is a k-d tree over the count vectors. Its
top, built from a sample that grows with the number of cells, says how to cut the words into
cells; a word goes to its home cell and visits the cells whose box lies within two of it, later
cells only of its own length's tree, and within one in the tree of words one letter longer. In
a cell the tree goes on until blocks are small; pairs within the bound are then compared letter
by letter. Each pair of near words is met in exactly one cell, which sends on a count and the
best partner of each word, never pairs.

Fixed bound, a parameter: MAX_CELLS cells (8 sampled words each), which decides cost, never
results; cells that grow beyond it are dealt out in parts.

Cases: a null or wordless text has no words; a null doc_id is written as an empty one before
the colon; repeated rows are counted each; runs and texts of any length are whole. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import slices
from trailhound.session import materialize

#: The query's task: every so many-th run loses a letter, words have so many letters and rows.
ODD = 31
LETTERS = 7
TIMES = 2
#: How much commoner than a word its form must be.
FACTOR = 10
#: Words a cell is home to, about; rows of one part of a cell; cells in all.
CELL_WORDS = 32768
PART_ROWS = 65536
MAX_CELLS = 1 << 15
CELL_SAMPLE = 8
#: Counted words a task holds.
HELD_WORDS = 400_000
#: Pairs compared at once.
BLOCK_PAIRS = 1 << 20
#: Counts are kept of a to z and of 12 groups of other letters.
OTHERS = 12
DIMS = 26 + OTHERS
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % OTHERS for c in range(256)], dtype=np.int64)


def runs(text: str, at_least: int = 1) -> list[str]:
    """The maximal runs of letters, A-Z lowered, of so many letters or more."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return re.findall("[a-zÀ-ÿ]{%d,}" % at_least, lowered)


def dealt_words(doc_id, text: str | None, letters: int = LETTERS) -> Counter:
    """The words of a text with at least so many letters, after the dealt deletions, and their counts."""
    out: Counter = Counter()
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text or "", letters)).items():
        h = zlib.crc32(run.encode(), begin)
        if h % ODD == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < letters:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n of the words of all texts that occur often enough."""

    def work(batches):
        held: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    for word, n in dealt_words(doc_id, text, letters).items():
                        held[word] += n
                    if len(held) > HELD_WORDS:
                        yield emptied()
        yield emptied()

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)
    )


def letter_matrix(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, length)


def counts_of(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), DIMS), dtype=np.int16)
    rows = np.arange(len(letters))
    for column in letters.T:
        out[rows, _DIM[column]] += 1
    return out


def marks(counts: np.ndarray) -> np.ndarray:
    """64 bits of which at most as many differ as the counts do: letter present, present twice;
    other letters present."""
    bits = np.concatenate([counts[:, :26] > 0, counts[:, :26] > 1, counts[:, 26:] > 0], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def middle(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count at which points are cut most evenly."""
    best = None
    for dim in np.argsort(-counts.var(axis=0), kind="stable")[:8]:
        column = counts[:, dim]
        at = int(np.median(column))
        for t in (at - 1, at):
            inside = int(np.count_nonzero(column <= t))
            if 0 < inside < len(column) and (best is None or abs(2 * inside - len(column)) < best[0]):
                best = (abs(2 * inside - len(column)), int(dim), t)
    return best and best[1:]


@dataclass
class Node:
    dim: int = 0
    at: int = 0
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


def build_tree(counts: np.ndarray, leaves: int) -> tuple[Node, int]:
    """The top of a tree over sampled points, and its number of leaves."""
    made = 0

    def grow(own: np.ndarray, wanted: int) -> Node:
        nonlocal made
        cut = middle(own) if wanted > 1 and len(own) > 1 else None
        if cut is None:
            made += 1
            return Node(leaf=made - 1)
        inside = own[:, cut[0]] <= cut[1]
        half = wanted // 2
        return Node(*cut, grow(own[inside], half), grow(own[~inside], wanted - half))

    return grow(counts, leaves), made


class Box:
    """Bounds of a tree's node, and how a cut changes points' distances to it."""

    def __init__(self, low: dict | None = None, high: dict | None = None):
        self.low, self.high = low or {}, high or {}

    def _beyond(self, dim: int, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.maximum(self.low.get(dim, 0) - x, x - self.high.get(dim, 1 << 14)))

    def halves(self, dim: int, at: int, x: np.ndarray, far: np.ndarray) -> Iterator[tuple["Box", np.ndarray]]:
        """The two halves, each with the distances of points whose distances here are `far`."""
        before = self._beyond(dim, x)
        for half in (Box(self.low, self.high | {dim: at}), Box(self.low | {dim: at + 1}, self.high)):
            yield half, far - before + half._beyond(dim, x)


def route(tree: Node, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaves whose boxes are within the radius, homes among them."""
    rows, leaves = [np.zeros(0, int)], [np.zeros(0, int)]

    def down(node: Node, box: Box, idx: np.ndarray, far: np.ndarray) -> None:
        if not len(idx):
            return
        if node.leaf >= 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), node.leaf))
            return
        for child, (half, d) in zip((node.inner, node.outer), box.halves(node.dim, node.at, counts[idx, node.dim], far)):
            near = d <= radius
            down(child, half, idx[near], d[near])

    down(tree, Box(), np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))
    return np.concatenate(rows), np.concatenate(leaves)


def homes(tree: Node, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.int64)

    def down(node: Node, idx: np.ndarray) -> None:
        if node.leaf >= 0:
            out[idx] = node.leaf
            return
        inside = counts[idx, node.dim] <= node.at
        down(node.inner, idx[inside])
        down(node.outer, idx[~inside])

    down(tree, np.arange(len(counts)))
    return out


def close_pairs(own: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose counts differ by at most the radius in sum, in blocks."""
    own_marks, other_marks = marks(own), marks(other)
    stack = [(np.arange(len(own)), np.arange(len(other)), Box(), np.zeros(len(other), dtype=np.int64))]
    while stack:
        a, b, box, far = stack.pop()
        if not len(a) or not len(b):
            continue
        cut = middle(own[a]) if len(a) > 64 and len(a) * len(b) > BLOCK_PAIRS // 16 else None
        if cut:
            inside = own[a, cut[0]] <= cut[1]
            for some, (half, d) in zip((a[inside], a[~inside]), box.halves(*cut, other[b, cut[0]], far)):
                near = d <= radius
                stack.append((some, b[near], half, d[near]))
            continue
        step = max(1, BLOCK_PAIRS // len(b))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(own_marks[a[at:at + step], None] ^ other_marks[None, b]) <= radius)
            i, j = a[at + i], b[j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                keep = np.abs(own[p] - other[q]).sum(axis=1) <= radius
                yield p[keep], q[keep]


def one_edit(longer: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows differ by one replaced letter or, in the longer row, one letter more."""
    if longer.shape[1] == other.shape[1]:
        return (longer != other).sum(axis=1) == 1
    head = np.logical_and.accumulate(longer[:, :-1] == other, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((longer[:, 1:] == other)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= other.shape[1]


#: Roles of a row in a part of a cell: at home, at home as a partner, a visitor of the same
#: length, a visitor one letter shorter.
HOME, PARTNER, VISITOR, SHORTER = 0, 1, 2, 3


def cell_partners(group: pd.DataFrame) -> pd.DataFrame:
    """word, near, best_n, best: of the near words within one part of a cell."""
    words = np.array([w.encode("latin-1") for w in group["word"]], dtype=object)
    n, role = group["n"].to_numpy(), group["role"].to_numpy()
    length = int(group["length"].iloc[0])
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), len(words), dtype=np.int64)
    own = np.nonzero(role == HOME)[0]
    letters = letter_matrix(list(words[own]), length)
    counts = counts_of(letters)
    # Each word of the cell's length once on the other side; at home it may be both.
    for others, size, radius in ((np.nonzero((role == PARTNER) | (role == VISITOR))[0], length, 2), (np.nonzero(role == SHORTER)[0], length - 1, 1)):
        if not len(own) or not len(others):
            continue
        other_letters = letter_matrix(list(words[others]), size)
        for i, j in close_pairs(counts, counts_of(other_letters), radius):
            keep = one_edit(letters[i], other_letters[j])
            i, j = i[keep], j[keep]
            a, b = own[i], others[j]
            # Two words at home meet twice; the pair counts where the rarer or later one is the partner.
            once = (role[b] != PARTNER) | (rank[a] < rank[b])
            a, b = a[once], b[once]
            for x, y in ((a, b), (b, a)):
                np.add.at(near, x, 1)
                np.minimum.at(best, x, rank[y])
    found = np.nonzero(near)[0]
    to = order[best[found]]
    return pd.DataFrame({"word": group["word"].to_numpy()[found], "near": near[found], "best_n": n[to], "best": group["word"].to_numpy()[to]})


@dataclass
class Cells:
    """For each length its tree, and in how many parts each cell's homes and visitors are dealt out."""

    trees: dict[int, Node]
    home_parts: dict[int, np.ndarray]
    other_parts: dict[int, np.ndarray]

    @classmethod
    def build(cls, sample: list[str], total: int, cell_words: int) -> Cells:
        by_length: dict[int, list[bytes]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word.encode("latin-1"))
        each = total / max(1, len(sample))
        cells = cls({}, {}, {})
        counts = {k: counts_of(letter_matrix(words, k)) for k, words in by_length.items()}
        for length, own in counts.items():
            wanted = int(np.ceil(len(own) * each / cell_words))
            tree, leaves = build_tree(own, wanted)
            cells.trees[length] = tree
            held = np.bincount(homes(tree, own), minlength=leaves) * each
            came = np.bincount(route(tree, own, 2)[1], minlength=leaves) * each
            if length - 1 in counts:
                came = came + np.bincount(route(tree, counts[length - 1], 1)[1], minlength=leaves) * each
            cells.home_parts[length] = np.maximum(1, np.ceil(held / PART_ROWS)).astype(np.int64)
            cells.other_parts[length] = np.maximum(1, np.ceil(came / (8 * PART_ROWS))).astype(np.int64)
        return cells

    def visits(self, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(length, rows, leaves, role) of words of one length."""
        length = letters.shape[1]
        counts = counts_of(letters)
        one = Node(leaf=0)
        tree = self.trees.get(length, one)
        home = homes(tree, counts)
        yield length, np.arange(len(letters)), home, HOME
        yield length, np.arange(len(letters)), home, PARTNER
        row, leaf = route(tree, counts, 2)
        later = leaf > home[row]
        yield length, row[later], leaf[later], VISITOR
        row, leaf = route(self.trees.get(length + 1, one), counts, 1)
        yield length + 1, row, leaf, SHORTER

    def parts(self, length: int, leaf: np.ndarray, role: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, i, j): a home row goes to its part i against every part j, others the other way."""
        one = np.ones(1, dtype=np.int64)
        h, o = self.home_parts.get(length, one)[leaf], self.other_parts.get(length, one)[leaf]
        mine, times = (h, o) if role == HOME else (o, h)
        row = np.repeat(np.arange(len(leaf)), times)
        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        own = (salt % mine)[row]
        return (row, own, other) if role == HOME else (row, other, own)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, near (how many words are one edit away), best_n, best (the commonest of them, ties
    to the first in code-point order) of each of `words` (word, n; each word once) that has any."""
    total = words.count()
    wanted = min(MAX_CELLS, max(64, total // cell_words * 2)) * CELL_SAMPLE * 8
    share = int(min(1.0, wanted / max(1, total)) * (1 << 32))
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < share).select("word").toArrow()["word"].to_pylist()
    cells = Cells.build(sorted(sample), total, cell_words)

    def send(batches):
        for frame in batches:
            lengths = frame["word"].str.len().to_numpy()
            for length in np.unique(lengths):
                some = frame[lengths == length]
                texts = [w.encode("latin-1") for w in some["word"]]
                salt = np.array([zlib.crc32(w) for w in texts], dtype=np.int64)
                for to, row, leaf, role in cells.visits(letter_matrix(texts, int(length))):
                    if not len(row):
                        continue
                    at, i, j = cells.parts(to, leaf, role, salt[row])
                    pick = some.iloc[row[at]]
                    yield pd.DataFrame({
                        "length": np.int32(to), "leaf": leaf[at].astype(np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32),
                        "role": np.int32(role), "word": pick["word"].to_numpy(), "n": pick["n"].to_numpy(),
                    })

    sent = words.select("word", "n").mapInPandas(send, "length int, leaf int, i int, j int, role int, word string, n long")
    found = sent.groupBy("length", "leaf", "i", "j").applyInPandas(cell_partners, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("near"), top).select(
        "word", "near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best")
    )


def roots(forms: DataFrame, most: int, factor: int = FACTOR) -> DataFrame:
    """word, root: the last of each chain word -> form. Counts grow by the factor with each
    step, so no chain is longer than their logarithm; the steps double in each round."""
    current, steps, reach = forms.select("word", F.col("form").alias("root")), 1, TIMES * factor
    while reach * factor <= most:
        steps, reach = steps + 1, reach * factor
    for _ in range(max(0, steps - 1).bit_length()):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("last"))
        current = materialize(current.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")))
    return current


def spelling_variants(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of every counted word."""
    words = materialize(count_words(docs))
    near = near_words(words)
    good = F.col("best_n") >= factor * F.col("n")
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
    ))
    most = words.agg(F.max("n")).first()[0] or 0
    last = roots(materialize(known.filter("form IS NOT NULL").select("word", "form")), most, factor)
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
