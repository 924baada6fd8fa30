"""Alignment of two tokenizers' tokens over the same bytes.

Where tokens of both end at the same byte, a text is cut into groups. A table made from the
two vocabularies has for each A id the B id with the same bytes; groups of just such a pair
are counted in vectors as long as the vocabulary. Only other pairs go through a shuffle, once
for each block of texts.

Both tokenizers begin anew at a space, or a line feed, behind a character that is not white
space, so a text's groups are those of its chunks, joined: each distinct chunk is encoded and
aligned once a worker. Texts whose white space does not cut this way are aligned whole.

A block of texts is one written row: what its texts' groups amount to, its pairs with the
number of texts that hold them, and which chunks each text has how often. The pairs' counts over
all texts come back to the block as one row, and give the texts' sums.

Cases: null and empty texts, and texts that a tokenizer does not give back byte for byte (such
as those with U+2581), have no tokens: zeros and ''. Rows that repeat count as documents of
their own; a null doc_id stays null. Texts of any length are aligned whole. An empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import slices
from trailhound.llm.piece import MARK, piece_path
from trailhound.llm.tokens import MemoEncoder, byte_bpe_path
from trailhound.session import materialize

#: Bytes of text in a block; one text may be longer.
BLOCK_BYTES = 8 << 20
#: Chunks of a generation; a worker keeps two. Longer chunks are not kept.
MEMO_CHUNKS = 200_000
MEMO_LENGTH = 200
SHIFT = 20
_POWERS = 10 ** np.arange(1, 10, dtype=np.int64)


class Records:
    """What chunks' groups amount to, by number: the groups' text, the numbers of tokens of A
    and B and of groups, and the linked pairs. Plain lists, as a worker holds very many."""

    def __init__(self):
        self.number: dict[str, int | None] = {}
        self.groups: list[str] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.n_groups: list[int] = []
        self.pairs: list[bytes] = []

    def add(self, groups: str, n_a: int, n_b: int, n_groups: int, pairs: bytes) -> int:
        self.groups.append(groups)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.n_groups.append(n_groups)
        self.pairs.append(pairs)
        return len(self.groups) - 1

    def take(self, other: "Records", n: int) -> int:
        return self.add(other.groups[n], other.n_a[n], other.n_b[n], other.n_groups[n], other.pairs[n])


def segments(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class Aligner:
    """Texts to groups and linked id pairs."""

    made: dict = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = MemoEncoder.of(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = self.a.bytes_of, np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.space, self.feed = self.b.piece_to_id(MARK), self.b.piece_to_id("<0x0A>")
        self.names = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        self.records, self.older = Records(), Records()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls.made:
            cls.made[a_path, b_path] = cls(a_path, b_path)
        return cls.made[a_path, b_path]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    @cached_property
    def same(self) -> np.ndarray:
        """The B id with the same bytes as each A id, or -1; of two, the one that is no byte piece."""
        char_of = bytes_to_chars()
        known = {}
        for i in range(len(self.b_bytes)):
            if not self.b.is_control(i) and not self.b.is_unknown(i) and (self.b_bytes[i] not in known or not self.b.is_byte(i)):
                known[self.b_bytes[i]] = i
        out = np.full(len(self.a_size), -1, dtype=np.int64)
        for piece, i in self.a.tokenizer.get_vocab().items():
            if all(c in char_of for c in piece):
                out[i] = known.get(bytes(char_of[c] for c in piece), -1)
        return out

    def _align(self, a_ids: np.ndarray, b_ids: np.ndarray, ends: np.ndarray) -> range:
        """Numbers of the new records of chunks that lie one behind the other and end at the
        given bytes."""
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        every = np.concatenate([a_end, b_end])
        every.sort(kind="stable")
        twice = np.append(every[1:] == every[:-1], False)
        both, every = every[twice], every[~twice]
        codes = (a_ids[np.searchsorted(a_end, every)] << SHIFT) | b_ids[np.searchsorted(b_end, every)]
        # Each group is written as its A ids and then its B ids, each id with a mark behind it.
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([a_ids, b_ids])[order]
        side = np.concatenate([2 * a_group, 2 * b_group + 1])[order]
        last = np.append(side[1:] != side[:-1], True)
        behind = np.where(~last, ",", np.where(side % 2 == 0, "|", ";")).tolist()
        text = "".join([x for pair in zip(map(self.names.__getitem__, ids.tolist()), behind) for x in pair])
        width = segments(np.searchsorted(_POWERS, ids, side="right") + 2)
        cut_g = np.searchsorted(both, ends, side="right")
        cut_a, cut_b = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        cut_t = width[cut_a + cut_b]
        cut_p = np.searchsorted(every, ends, side="right")
        own, raw = self.records, codes.tobytes()
        for to, cut in ((own.n_a, cut_a), (own.n_b, cut_b), (own.n_groups, cut_g)):
            to += np.diff(cut, prepend=0).tolist()
        begin, cut_t, cut_p = len(own.groups), [0, *cut_t.tolist()], [0, *(8 * cut_p).tolist()]
        own.groups += [text[x:y - 1] for x, y in zip(cut_t, cut_t[1:])]
        own.pairs += [raw[x:y] for x, y in zip(cut_p, cut_p[1:])]
        return range(begin, len(own.groups))

    def _whole(self, text: str | None) -> int:
        """The number of a whole text's record, with the space before it."""
        if not text:
            return self.records.add("", 0, 0, 0, b"")
        a_ids = self.a._plain(" " + text).astype(np.int64)
        b_ids = np.array(self.b.encode(text), dtype=np.int64)
        raw = (" " + text).encode()
        if b"".join([self.b_bytes[i] for i in b_ids.tolist()]) != raw or self.a_size[a_ids].sum() != len(raw):
            return self.records.add("", 0, 0, 0, b"")
        return self._align(a_ids, b_ids, np.array([len(raw)]))[0]

    def _learn(self, chunks: list[str]) -> None:
        """Records of new chunks, each behind its space or with its line feed; None where only
        the whole text tells."""
        a_ids = self.a._apart(chunks)
        fit, a_fit, b_fit, ends = [], [], [], []
        for chunk, a, b in zip(chunks, a_ids, self.b.encode(chunks)):
            raw = chunk.encode()
            if chunk[0] == "\n":
                b = b[1:] if b[:2] == [self.space, self.feed] else []
            else:
                raw = b" " + raw
            if b"".join([self.b_bytes[i] for i in b]) == raw:
                fit.append(chunk)
                a_fit.append(a)
                b_fit += b
                ends.append(len(raw))
            else:
                self.records.number[chunk] = None
        if fit:
            a_all = np.frombuffer(b"".join(a_fit), dtype="<u4").astype(np.int64)
            self.records.number.update(zip(fit, self._align(a_all, np.array(b_fit, dtype=np.int64), np.cumsum(ends))))

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """Of each text the numbers of its chunks' records, or of its own. They hold for the
        `records` there are after the call."""
        if len(self.records.groups) > MEMO_CHUNKS:
            self.records, self.older = Records(), self.records
        known, older = self.records.number, self.older
        cut = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        new = set().union(*cut)
        new.difference_update(known)
        for chunk in new.intersection(older.number):
            n = older.number[chunk]
            known[chunk] = None if n is None else self.records.take(older, n)
        new.difference_update(known)
        fit = [c for c in new if c and len(c) <= MEMO_LENGTH and not c[-1].isspace()]
        known.update(dict.fromkeys(new))
        for at in range(0, len(fit), 20_000):
            self._learn(fit[at:at + 20_000])
        out = []
        for text, chunks in zip(texts, cut):
            found = list(map(known.__getitem__, chunks))
            out.append([self._whole(text)] if None in found else found)
        for chunk in new:
            if len(chunk) > MEMO_LENGTH:
                del known[chunk]
        return out


def bytes_to_chars() -> dict[str, int]:
    """Of each character of the byte-level alphabet its byte: printable bytes are themselves,
    the others follow from U+0100 in order."""
    plain = [b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small whole numbers as compressed bytes, lowest bytes together."""
    sizes = np.array([len(a) for a in arrays], dtype="<u4")
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    raw = sizes.tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes, count: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, dtype="<u4", count=count).tolist(), 4 * count, []
    for n in sizes:
        plane = np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n)
        out.append(np.ascontiguousarray(plane.T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return out


class Block:
    """Texts gathered until they make one row."""

    def __init__(self, same: np.ndarray, records: Records):
        self.same, self.records, self.size = same, records, 0
        self.rows: list[tuple] = []
        self.of_text: list[np.ndarray] = []

    def add(self, doc_id, numbers: list[int], size: int) -> None:
        groups = ";".join(map(self.records.groups.__getitem__, numbers))
        self.rows.append((doc_id, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
        self.of_text.append(np.array(numbers, dtype=np.int64))
        self.size += size

    def row(self, number: int) -> dict:
        # Which chunks each text has and how often, and which pairs each chunk has.
        text = np.repeat(np.arange(len(self.rows)), [len(x) for x in self.of_text])
        used, chunk = np.unique(np.concatenate(self.of_text), return_inverse=True)
        kept = [self.records.pairs[i] for i in used.tolist()]
        key, times = np.unique(text * len(kept) + chunk, return_counts=True)
        text, chunk = np.divmod(key, len(kept))
        codes = np.frombuffer(b"".join(kept), dtype=np.int64)
        length = np.array([len(p) // 8 for p in kept], dtype=np.int64)
        pairs, pair = np.unique(codes, return_inverse=True)
        # In how many texts each pair is; a part of the texts at a time.
        begin, docs = segments(length), np.zeros(len(pairs), dtype=np.int64)
        step = max(1, len(text) // max(1, int(length[chunk].sum()) // (1 << 21) + 1))
        cuts = np.searchsorted(text, np.unique(text[::step])).tolist() + [len(text)]
        for a, b in zip(cuts, cuts[1:]):
            n = length[chunk[a:b]]
            inner = np.arange(n.sum()) - np.repeat(segments(n)[:-1], n)
            which = pair[np.repeat(begin[chunk[a:b]], n) + inner]
            held = np.unique(np.repeat(text[a:b], n) * len(pairs) + which)
            docs += np.bincount(held % max(1, len(pairs)), minlength=len(pairs)) if len(pairs) else 0
        regular = self.same[pairs >> SHIFT] == (pairs & ((1 << SHIFT) - 1))
        # Chunks in order of use have small numbers, which compress well.
        rank = np.empty(len(kept), dtype=np.int64)
        rank[np.argsort(-np.bincount(chunk, minlength=len(kept)), kind="stable")] = np.arange(len(kept))
        order = np.lexsort((rank[chunk], text))
        chunk, times = rank[chunk][order], times[order]
        first = np.append(True, text[1:] != text[:-1])
        by_rank = np.argsort(rank)
        inner = np.arange(length.sum()) - np.repeat(segments(length[by_rank])[:-1], length[by_rank])
        of_kept = [np.array([column[i] for i in used.tolist()], dtype=np.int64)[by_rank] for column in (self.records.n_a, self.records.n_b, self.records.n_groups)]
        begins = segments(np.bincount(text, minlength=len(self.rows)))
        n_a, n_b, n_groups = (np.diff(segments(n[chunk] * times)[begins]) for n in of_kept)
        # A link ends wherever a token of either side does.
        doc_ids, digests = zip(*self.rows)
        columns = (doc_ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), (n_a + n_b - n_groups).tolist(), digests)
        return {
            "block": number, "same": pairs[regular] >> SHIFT, "same_docs": docs[regular],
            "pairs": pairs[~regular], "pair_docs": docs[~regular],
            "payload": packed(
                np.bincount(text, minlength=len(self.rows)), np.where(first, chunk, np.diff(chunk, prepend=0)), times,
                length[by_rank], pair[np.repeat(begin[by_rank], length[by_rank]) + inner], regular, pairs >> SHIFT,
            ),
            "docs": [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row)) for row in zip(*columns)],
        }


DOC = "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string"
BLOCK = f"block long, same array<long>, same_docs array<long>, pairs array<long>, pair_docs array<long>, payload binary, docs array<struct<{DOC}>>"


def _to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts in blocks, one row each (see BLOCK)."""
    schema = _to_arrow(BLOCK)

    def work(batches):
        aligner = Aligner.of(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        block = Block(aligner.same, aligner.records)

        def emptied() -> pa.RecordBatch:
            row = block.row(number)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                found = aligner.numbers(texts)
                for doc_id, text, numbers in zip(part["doc_id"].to_pylist(), texts, found):
                    size = len(text or "")
                    if block.records is not aligner.records or block.size + size > block_bytes:
                        if block.rows:
                            yield emptied()
                            number += 1
                        block = Block(aligner.same, aligner.records)
                    block.add(doc_id, numbers, size)
        if block.rows:
            yield emptied()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, BLOCK)


def _finish(same: np.ndarray, best: np.ndarray):
    """Blocks with their pairs' counts to documents' sums."""
    schema = _to_arrow(RESULT)

    def run(batches):
        for batch in batches:
            for payload, docs, totals in zip(batch["payload"], batch["docs"], batch["totals"]):
                size, chunk, times, length, pair, regular, a = unpacked(payload.as_py(), 7)
                count = np.zeros(len(a), dtype=np.int64)
                count[regular == 1] = same[a[regular == 1]]
                if totals.is_valid:
                    flat = totals.values
                    at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                    other = np.nonzero(regular == 0)[0]
                    count[other[at]] = n
                ends = segments(length)
                sums = [np.diff(segments(v[pair])[ends]) for v in (count, (count == best[a]).astype(np.int64))]
                # Chunk numbers are differences within a text.
                begin = segments(size)
                whole = segments(chunk)[1:]
                chunk = whole - np.repeat(segments(chunk)[begin[:-1]], size)
                total, bests = (np.diff(segments(s[chunk] * times)[begin]) for s in sums)
                rows = docs.values.flatten()
                names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                own = dict(zip(names, rows)) | {"n_best": pa.array(bests), "count_sum": pa.array(total)}
                yield pa.RecordBatch.from_arrays([own[f.name] for f in schema], schema=schema)

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_tokens(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    a_path, b_path = a_path or byte_bpe_path(), b_path or piece_path()
    made = materialize(blocks(docs, a_path, b_path, block_bytes))
    vector = len(MemoEncoder.of(a_path).bytes_of)
    # Sums in vectors: a row for each A id at most.
    same, best = np.zeros(vector, dtype=np.int64), np.zeros(vector, dtype=np.int64)
    counted = made.select(F.explode(F.arrays_zip("same", "same_docs")).alias("s")).groupBy("s.same").agg(F.sum("s.same_docs").alias("n"))
    for row in counted.collect():
        same[row["same"]] = row["n"]
    pairs = made.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("n")
    )
    totals = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    for row in totals.groupBy(F.shiftright("pair", SHIFT).cast("int").alias("a")).agg(F.max("n").alias("n")).collect():
        best[row["a"]] = row["n"]
    best = np.maximum(best, same)
    back = pairs.drop("n").join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("totals"))
    return (
        made.select("block", "payload", "docs").join(back, "block", "left").select("payload", "docs", "totals")
        .mapInArrow(_finish(same, best), RESULT)
    )
