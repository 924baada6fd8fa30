"""Token counts by field: one encoding per document, its tokens laid over the fields.

A document is written out as `source lang\\n` and its text, and cut into fields without gaps:
the source, the language, and each line with its line end. The whole is encoded once; a
byte-level token covers as many bytes as its vocabulary entry, so running sums give every
token's byte span, and with the characters' first bytes its character span. Token spans are
then joined with field spans by search in their sorted bounds.

Rule for a token that crosses a boundary: it counts for the field that has most of its
characters, of equal ones for the first; `n_crossing` tells how many of a field's tokens
also reach into another. Tokens of a part of one character count as having that character.
So every token counts once, and a document's fields add up to its tokens.

Cases: null text, source or language are empty, and their fields have what separates them;
an empty last line is no field; repeated rows stay; long texts are encoded whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import map_batches
from trailhound.llm.tokens import MemoEncoder, byte_bpe_path


def layout(source: str | None, lang: str | None, text: str | None) -> tuple[str, list[str], list[int]]:
    """The document as encoded, its fields' names and their ends in characters."""
    lines = (text or "").split("\n")
    sizes = [len(x) + 1 for x in lines]
    sizes[-1] -= 1
    if not sizes[-1]:
        sizes.pop()
    head = [len(source or "") + 1, len(lang or "") + 1]
    whole = f"{source or ''} {lang or ''}\n{text or ''}"
    return whole, ["source", "lang", *["line"] * len(sizes)], np.cumsum(head + sizes).tolist()


def token_spans(ids: np.ndarray, bytes_of: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token."""
    ends = np.cumsum(bytes_of[ids])
    begins = ends - bytes_of[ids]
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character a byte belongs to
    return char[begins], char[ends - 1] + 1


def allocate(begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field of each token, and whether the token reaches beyond that field."""
    first = np.searchsorted(bounds, begins, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    field = first.copy()
    for i in np.nonzero(first != last)[0]:  # few: those on a boundary
        edges = np.concatenate([[begins[i]], bounds[first[i]:last[i]], [ends[i]]])
        field[i] = first[i] + int(np.argmax(np.diff(edges)))
    return field, first != last


class _Attribute:
    def __init__(self, path: str):
        self.path = path

    def start(self):
        encoder = MemoEncoder.of(self.path)

        def work(rows: dict) -> dict:
            laid = [layout(*x) for x in zip(rows["source"], rows["lang"], rows["text"])]
            out: dict[str, list] = {k: [] for k in ("doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing")}
            for doc_id, (whole, names, ends), raw_ids in zip(rows["doc_id"], laid, encoder.encode([x[0] for x in laid])):
                ids = np.frombuffer(raw_ids, dtype="<u4")
                bounds, n = np.array(ends), len(names)
                begin, end = token_spans(ids, encoder.bytes_of, whole.encode())
                field, crossing = allocate(begin, end, bounds)
                out["doc_id"] += [doc_id] * n
                out["section"] += range(n)
                out["field"] += names
                out["start"] += [0, *ends[:-1]]
                out["end"] += ends
                out["n_tokens"] += np.bincount(field, minlength=n).tolist()
                out["n_crossing"] += np.bincount(field[crossing], minlength=n).tolist()
            return out

        return work


def attribute_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, section, field, start, end (characters), n_tokens, n_crossing per field."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]]
    return map_batches(
        docs.select(*columns), _Attribute(tokenizer or byte_bpe_path()),
        "doc_id long, section int, field string, start long, end long, n_tokens long, n_crossing long",
    )
