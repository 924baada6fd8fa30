"""Encoding with the tokenizers library, each distinct space-led chunk encoded once.

The byte-level pre-tokenizer starts a new word at every space or line feed that follows a
character that is not white space (a line feed before a word is a word of its own), so the ids
of a text are those of its chunks, joined. Chunks repeat; their ids are kept. A chunk of
letters with one mark behind them is two words, of which the first may be known. Texts whose
white space does not cut this way are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks of a generation. A worker keeps two: what it does not meet again for so many new
#: chunks is forgotten.
MEMO_CHUNKS = 320_000
#: Chunks encoded as one text.
TOGETHER = 500
#: Letters that are letters in any version of Unicode, and a mark.
_MARKED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+[.,;:!?]")
_made: dict = {}


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str):
    """The tokenizer of a file; special tokens' strings in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class MemoEncoder:
    """texts -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.memo: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for piece, i in vocabulary.items():  # in the byte-level alphabet a character is a byte
            self.bytes_of[i] = len(piece)

    @classmethod
    def of(cls, path: str) -> MemoEncoder:
        """One per worker process and file."""
        if ("bytes", path) not in _made:
            _made["bytes", path] = cls(path)
        return _made["bytes", path]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _apart(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk with its leading white space, from encodings of many together."""
        led = [c if c[0] == "\n" else f" {c}" for c in chunks]
        groups = ["".join(led[i:i + TOGETHER]) for i in range(0, len(led), TOGETHER)]
        found = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        ends = np.cumsum([len(c.encode()) for c in led])
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        raw, out, begin = ids.tobytes(), [], 0
        for end in (4 * cuts).tolist():
            out.append(raw[begin:end])
            begin = end
        return out

    def _head(self, chunk: str) -> bytes:
        """The ids of a text's first chunk, which has no space before it."""
        ids = self.heads.get(chunk)
        if ids is None:
            ids = self.heads[chunk] = self._plain(chunk).tobytes()
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_CHUNKS:
            self.memo, self.older = {}, self.memo
        if len(self.heads) > MEMO_CHUNKS // 10:
            self.heads.clear()
        memo, older = self.memo, self.older
        cut = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        new = set().union(*cut).difference(memo)
        again = new.intersection(older)
        memo.update(zip(again, map(older.__getitem__, again)))
        new -= again
        marked = list(filter(_MARKED.fullmatch, new))
        whole = new.difference(marked)
        whole.update(c[:-1] for c in marked if c[:-1] not in memo)
        fit = [c for c in whole if c and not c[-1].isspace()]
        memo.update(dict.fromkeys(whole))  # None: this chunk does not end a word
        if fit:
            memo.update(zip(fit, self._apart(fit)))
        memo.update((c, memo[c[:-1]] + self._head(c[-1])) for c in marked)
        out = []
        for text, chunks in zip(texts, cut):
            parts = list(map(memo.__getitem__, chunks))
            # A chunk that is empty or ends in white space joins the space after it.
            if None in parts:
                out.append(self._plain(text or "").tobytes())
            else:
                parts[0] = self._head(chunks[0])
                out.append(b"".join(parts))
        return out
