"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, scheme separators and
identifier cues. At each, a local parser expands and checks one kind of span, never looking
beyond the characters that the span may hold. Per kind, spans are leftmost and do not
overlap; a candidate that fails its check is dropped and not tried again from its inside.

Kinds, in order: email, ip, card, phone (fixed patterns, checked by part size, Luhn sum or
number of digits); then url (scheme and host), account (a cue such as IBAN, SSN or account
number with a valid number behind it) and secret (a password or key cue with its value).

Cues are found in any case. Cases: a null text has no spans; an empty table gives no rows;
repeated rows stay; texts of any length are scanned whole, in linear time; other columns are
ignored, and kept by `mask_documents`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import Column, DataFrame, functions as F

from trailhound.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

# The characters of each kind.
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LOCATION = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"[\s:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?\x20{0,2}[:#=]\x20{0,2}([A-Z0-9][A-Z0-9-]{5,33})(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?([A-Za-z0-9_./+=-]{8,})")

CUES = {
    "iban": ("account", _IBAN), "ssn": ("account", _SOCIAL), "social security number": ("account", _SOCIAL),
    "account": ("account", _NUMBER), "passport": ("account", _NUMBER),
    "password": ("secret", _VALUE), "passwd": ("secret", _VALUE), "token": ("secret", _VALUE),
    "secret": ("secret", _VALUE), "api_key": ("secret", _VALUE), "api-key": ("secret", _VALUE), "apikey": ("secret", _VALUE),
}
_machine = None


def _automaton() -> ahocorasick.Automaton:
    global _machine
    if _machine is None:
        made = ahocorasick.Automaton()
        for anchor in ("@", "+", "://", *"0123456789"):
            made.add_word(anchor, ("digit" if anchor.isdigit() else anchor, ""))
        for cue in CUES:
            made.add_word(cue, ("cue", cue))
        made.make_automaton()
        _machine = made
    return _machine


def _lowered(text: str) -> str:
    """The text in small letters at the same places, so that cues of any case are found."""
    small = text.lower()
    if len(small) == len(text):
        return small
    return "".join([s if len(s := c.lower()) == 1 else c for c in text])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) << (i & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _iban_valid(value: str) -> bool:
    packed = value.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the search of each kind goes on

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, KINDS.index(kind), end))

    for last, (anchor, cue) in _automaton().iter(_lowered(text)):
        if anchor == "digit":
            if last >= done["ip"]:
                m = _DOTTED.match(text, last)
                done["ip"] = m.end() if m else _DIGITS.match(text, last).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    add("ip", last, m.end())
            if last >= done["card"]:
                m = _SPACED.match(text, last)
                done["card"] = m.end() if m else last + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", last, m.end())
        elif anchor == "@":
            m = _DOMAIN.match(text, last + 1)
            start = last
            while m and start > done["email"] and text[start - 1] in _LOCAL_PART:
                start -= 1
            if m and start < last:
                add("email", start, m.end())
                done["email"] = m.end()
        elif anchor == "+":
            m = _DIALLED.match(text, last) if last >= done["phone"] else None
            if m:
                done["phone"] = m.end()
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    add("phone", last, m.end())
        elif anchor == "://":
            if last >= done["url"]:
                # Back over the scheme, which begins with a letter; its characters hold no anchor of
                # this kind, so no text is walked over twice.
                start = scheme = last - 2
                while start > done["url"] and text[start - 1] in _SCHEME:
                    start -= 1
                    if text[start].isalpha():
                        scheme = start
                m = _LOCATION.match(text, last + 1)
                end = last + 1 + len(m.group().rstrip(".,;:!?)")) if m else last
                if scheme < last - 2 and end > last + 1 and text[last + 1].isalnum():
                    add("url", scheme, end)
                    done["url"] = end
        else:
            kind, shape = CUES[cue]
            first = last - len(cue) + 1
            m = shape.match(text, last + 1) if first == 0 or not text[first - 1].isalnum() else None
            if m and m.start(1) >= done[kind]:
                value = m.group(1)
                if any(map(str.isdigit, value)) and (shape is not _IBAN or _iban_valid(value)):
                    add(kind, *m.span(1))
                    done[kind] = m.end(1)
    return sorted(found)


def _scan(rows: dict) -> dict:
    return {**rows, "spans": [
        [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t)] for t in rows["text"]
    ]}


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and kind."""
    found = map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _Only(("doc_id", "spans")), "doc_id long, spans array<struct<kind:string,start:long,end:long>>",
    )
    return found


class _Only:
    """The scan, keeping some of its columns."""

    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def __call__(self, rows: dict) -> dict:
        out = _scan(rows)
        return {k: out[k] for k in self.names}


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans in writing."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def mask(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in
    angle brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with masked texts; n_chars follows the new text, other columns stay."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "n_chars")]
    schema = docs.schema

    def work(rows: dict) -> dict:
        texts = [mask(t) for t in rows["text"]]
        sizes = {"n_chars": [n if t is u else len(t) for n, t, u in zip(rows["n_chars"], texts, rows["text"])]} if "n_chars" in rows else {}
        return {**{f.name: rows[f.name] for f in others}, "text": texts, **sizes}

    return map_batches(docs, work, schema)
