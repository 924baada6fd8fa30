"""JSON text as variants, as strict as Python's own parser about what follows a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_END = "~end~"


def once(value: Column) -> Column:
    """The value out of a generator: a plain column would be worked out again in every
    filter that the optimizer pushes below it. The outer form, as the plain one adds such
    a filter itself."""
    return F.explode_outer(F.array(value))


# Numbers that only Python's parser knows, each up to its next place outside strings. The
# first is replaced before the second, which ends like it.
_ODD = {
    "1": r'\G((?:[^"-]|"(?:[^"\\]|\\.)*+"|-(?!Infinity))*+)-Infinity',
    "2": r'\G((?:[^"I]|"(?:[^"\\]|\\.)*+"|I(?!nfinity))*+)Infinity',
    "3": r'\G((?:[^"N]|"(?:[^"\\]|\\.)*+"|N(?!aN))*+)NaN',
}
_TOKENS = {"1": "-Infinity", "2": "Infinity", "3": "NaN"}


def odd_mark(text: Column) -> Column:
    """For a text that may hold such numbers the digits that stand for them while it is
    parsed: an ordinary number, not zero, made from the text's own hash, so not in the text."""
    digits = F.lpad(F.pmod(F.xxhash64(text), F.lit(10**15)).cast("string"), 15, "0")
    return F.when(text.contains("NaN") | text.contains("Infinity"), F.concat(F.lit("0.5"), digits))


def _plain_numbers(text: Column, mark: Column) -> Column:
    plain = text
    for last, pattern in _ODD.items():
        plain = F.regexp_replace(plain, F.lit(pattern), F.concat(F.lit("$1"), mark, F.lit(last)))
    return F.when(mark.isNotNull(), plain).otherwise(text)


def with_odd_numbers(json: Column, mark: Column) -> Column:
    """JSON text with the numbers back that `mark` stands for."""
    back = json
    for last, token in _TOKENS.items():
        back = F.replace(back, F.concat(mark, F.lit(last)), F.lit(token))
    return F.when(mark.isNull(), json).otherwise(back)


def _wrapped(text: Column) -> Column:
    """A list of the text's value and an end mark."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def _items(pair: Column) -> Column:
    return F.try_variant_get(pair, "$", "array<variant>")


def _unwrapped(pair: Column) -> Column:
    # All items come from one cast: a path to a place that is not there costs an exception.
    whole = (F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == _END)
    return F.when(whole, F.get(pair, F.lit(0)))


def strict_json(text: Column) -> Column:
    """The JSON value of a text, NULL when the text is anything but one value.

    `try_parse_json` stops after the first value and ignores the rest. As the first of two
    list items a value cannot be followed by anything.
    """
    return _unwrapped(_items(_wrapped(_plain_numbers(text, odd_mark(text)))))


def with_json(rows: DataFrame, text: Column, name: str, mark: str = "_mark") -> DataFrame:
    """Add the strict JSON value of a text, parsed once per row, and under the name `mark` what
    stands for numbers that only Python's parser knows. They are looked for in what cannot be
    read otherwise: a text with one outside strings cannot."""
    plain = rows.select("*", once(_wrapped(text)).alias("_plain"))
    marked = plain.withColumn(mark, once(F.when(F.col("_plain").isNull(), odd_mark(text))))
    pair = F.when(F.col(mark).isNotNull(), _wrapped(_plain_numbers(text, F.col(mark)))).otherwise(F.col("_plain"))
    out = marked.withColumn("_items", once(_items(pair))).withColumn(name, once(_unwrapped(F.col("_items"))))
    return out.drop("_plain", "_items", "_mark")
