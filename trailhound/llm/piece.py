"""SentencePiece models in the tokenizers library.

The model file is a protocol buffer; its few needed fields are read here. From them the
tokenizers pipeline is built anew: normalizer (precompiled map, space runs, word marker),
unigram scores or, for a BPE model, merges ranked by the score of what they make, and byte
fallback. A worker encodes in batches, in several threads.

No piece of a model that splits at white space holds the marker behind another character, so a
text's ids are those of its marked words, joined; each distinct word is encoded, and its ids
decoded, once by the tokenizers library. Texts that are not words with single spaces between
are encoded and decoded whole. The ids of every whole text are then compared with those that
the sentencepiece library gives for it, and the joined decoding with that library's decoding of
the whole (`parity`); nothing is kept from one row's comparison to the next.

Cases: a null text is empty and has no ids; repeated rows stay; texts of any length are
encoded whole. A text decodes to itself but for what the model's normalizer changes.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import map_batches

MARK = "▁"
THREADS = 2
MEMO_WORDS = 250_000
#: New words encoded as one text.
WORDS_TOGETHER = 200
#: Characters of texts whose ids both libraries hold at a time; one text may be longer.
TOGETHER = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a message's fields: int, bytes, or 4 or 8 raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not known")


@dataclass
class Spec:
    """What a model file says. The numbers are its format's."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def read(cls, data: bytes) -> Spec:
        spec = cls()
        for number, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                spec.pieces.append((text, score, kind))
            elif number == 2:
                found = dict(fields(value))
                spec.kind = found.get(3, UNIGRAM)
                spec.byte_fallback = bool(found.get(35, 0))
            elif number == 3:
                found = dict(fields(value))
                spec.charsmap = found.get(2, b"")
                spec.dummy_prefix = bool(found.get(3, 1))
                spec.strip_spaces = bool(found.get(4, 1))
                spec.escape_spaces = bool(found.get(5, 1))
        spec.unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), 0)
        return spec

    @property
    def by_words(self) -> bool:
        """Whether no piece can reach across the space before a word."""
        return self.dummy_prefix and self.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which they join: by the score of what they make."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    number = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    found = []
    for whole, s in score.items():
        for cut in range(1, len(whole)):
            a, b = whole[:cut], whole[cut:]
            if a in score and b in score:
                found.append((-s, number[whole], number[a], number[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(spec: Spec):
    """The tokenizer of a model. Control pieces are no part of texts and are not recognised."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        model = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges=merges(spec),
            unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are known")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.strip_spaces:
        steps += [normalizers.Replace(Regex(r"^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_spaces else " "))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(model)
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])
    )
    return tokenizer


def parts(texts: list[str | None]):
    """Runs of texts of about TOGETHER characters."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text or "") > TOGETHER:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(text or "")
    if texts:
        yield texts[begin:]


class Codec:
    """Batches of texts to ids, and ids to texts."""

    made: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:  # a file of the installed library, on every machine
            self.spec = Spec.read(f.read())
        self.tokenizer = build(self.spec)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_words = self.spec.by_words
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL,) else p.replace(MARK, " ").encode()
            for p, _, kind in self.spec.pieces
        ]
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _own(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded texts by the tokenizers library."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(array("I", i).tobytes(), t) for i, t in zip(ids, back)]

    def _words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """The same of words, many encoded as one text: a word's ids begin where a piece begins
        with the marker, its decoding behind a space."""
        out = []
        groups = [words[i:i + WORDS_TOGETHER] for i in range(0, len(words), WORDS_TOGETHER)]
        for group, (ids, text) in zip(groups, self._own([" ".join(g) for g in groups])):
            cuts = np.nonzero(self.begins[np.frombuffer(ids, dtype="<u4")])[0]
            back = text.split(" ")
            if len(cuts) == len(back) == len(group):
                cuts = [*(4 * cuts).tolist(), len(ids)]
                out += [(ids[a:b], t) for a, b, t in zip(cuts, cuts[1:], back)]
            else:
                out += self._own(group)
        return out

    def _joined(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Little-endian ids and decoded texts by the tokenizers library, of words or else of
        whole texts. A word's ids begin with the marker, so what they decode to is joined by spaces."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        memo = self.memo
        cut = [t.split(" ") if t and self.by_words and MARK not in t else None for t in texts]
        new = set().union(*filter(None, cut)).difference(memo)
        again = new.intersection(self.older)
        memo.update(zip(again, map(self.older.__getitem__, again)))
        fit = [w for w in new - again if w]
        memo.update(zip(fit, self._words(fit)))
        out: list = []
        whole = []
        for i, (text, words) in enumerate(zip(texts, cut)):
            known = list(map(memo.get, words)) if words else []
            if text and (not known or None in known):
                whole.append(i)
                out.append(None)
            else:
                ids, parts = zip(*known) if known else ((), ())
                out.append((b"".join(ids), " ".join(parts)))
        for i, found in zip(whole, self._own([texts[i] for i in whole]) if whole else ()):
            out[i] = found
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        """Little-endian ids, and whether the sentencepiece library gives the same for the whole text."""
        return [(ids, same) for ids, same, _, _ in self._compared(texts)]

    def _compared(self, texts: list[str | None]) -> Iterator[tuple[bytes, bool, str, list[int]]]:
        for part in parts(texts):
            theirs = self.other.encode([t or "" for t in part], num_threads=THREADS)
            for (ids, back), other in zip(self._joined(part), theirs):
                same = ids == array("I", other).tobytes()
                yield ids, same, back, other if same else np.frombuffer(ids, dtype="<u4").tolist()

    def round_trip(self, texts: list[str | None]) -> list[tuple[bytes, bool, str]]:
        """Ids, whether sentencepiece agrees on them and on the decoding of the whole, and
        decoded text."""
        out = []
        for part in parts(texts):
            found = list(self._compared(part))
            theirs = self.other.decode([f[3] for f in found], num_threads=THREADS)
            out += [(ids, same and back == other, back) for (ids, same, back, _), other in zip(found, theirs)]
        return out

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


class _RoundTrip:
    def __init__(self, path: str):
        self.path = path

    def start(self):
        codec = Codec.of(self.path)

        def work(rows: dict) -> dict:
            found = codec.round_trip(rows["text"])
            return {
                "doc_id": rows["doc_id"], "n_tokens": [len(f[0]) // 4 for f in found],
                "ids_crc32": [zlib.crc32(f[0]) for f in found], "parity": [f[1] for f in found],
                "decoded": [f[2] for f in found],
            }

        return work


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, decoded of every row."""
    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _RoundTrip(model or piece_path()),
        "doc_id long, n_tokens long, ids_crc32 long, parity boolean, decoded string",
    )
