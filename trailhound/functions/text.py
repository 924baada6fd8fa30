"""String and time helpers whose results must agree with Python's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


# Every character that Unicode calls white space, and the four separators Python adds.
_BLANKS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim all whitespace, not only spaces. Trimming at the end walks through the whole text, so
    it is done where the last character asks for it."""
    ends = reduce(Column.__or__, [c.endswith(blank) for blank in _BLANKS])
    return F.when(ends, F.btrim(c, F.lit(_BLANKS))).otherwise(F.ltrim(c, F.lit(_BLANKS)))


# Characters whose case-folded form is not their lower-case form, by rule.
_FOLDS = {
    chr(i): chr(i).casefold()
    for i in range(0x80, 0x20000)
    if chr(i).casefold() != chr(i).lower()
}
_FOLD_MAP = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in _FOLDS.items()) + ")"


def casefold(c: Column) -> Column:
    """Case-insensitive form. Plain ASCII, the usual case, needs `lower` only."""
    folds = F.expr(_FOLD_MAP)
    folded = F.array_join(
        F.transform(
            F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)),
            lambda ch: F.coalesce(F.try_element_at(folds, ch), F.lower(ch)),
        ),
        "",
    )
    return F.when(c.rlike("[^\\x00-\\x7f]"), folded).otherwise(F.lower(c))


def snake(name: Column) -> Column:
    """ConsoleLogin -> console_login; runs of capitals stay together."""
    return F.lower(F.regexp_replace(name, r"(?<=[^\p{Lu}])(\p{Lu})", "_$1"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def iso_utc(ts: Column) -> Column:
    """2026-08-02T04:41:07+00:00, with six fraction digits only when not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        whole,
        F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, "").otherwise(fraction),
        F.lit("+00:00"),
    )


def to_utc(c: Column) -> Column:
    """A time without a zone is taken as UTC (the session zone is pinned to UTC)."""
    return c.cast("timestamp")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def flatten_line(raw: Column, limit: int) -> Column:
    return F.substring(F.replace(raw, F.lit("\n"), F.lit(" ")), 1, limit)


def normalize_technique(c: Column) -> Column:
    return F.upper(strip(c))


def is_subtechnique(c: Column) -> Column:
    return F.contains(c, F.lit("."))


def parent_technique(c: Column) -> Column:
    return F.when(is_subtechnique(c), F.substring_index(c, ".", 1))
