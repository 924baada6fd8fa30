"""Quality rules: robust multivariate outliers.

Counts of each text become a vector of transformed statistics. Per language and source a
minimum-covariance-determinant estimate (Rousseeuw & Van Driessen 1999) gives centre and
scatter, by concentration steps over all documents; a document far from its group's centre in
Mahalanobis distance is rejected, as is one that fails the base rules.

A concentration step is one pass: sums of the vectors and their products per group and bin of
distance, pre-aggregated in every task, of which the bins nearest the centre that hold the
wanted share are added up. Coordinates are whole numbers of 1/256, so the sums are exact and
do not depend on the order of rows. No step sees a group's rows together.

Cases: a null text has no words and fails the base rules, as all texts of under 20 words do.
Null languages and sources are groups. Groups with fewer than `least` documents pool by
language, then altogether; what is still fewer has no estimate, and the base rules decide
(distance2 is null). Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import eq
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trailhound.llm.common import map_batches
from trailhound.session import materialize

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Share of a group that an estimate rests on, and its concentration steps. Half is the share
#: that bears most outliers: whatever is less than half of a group need not enter its core.
CORE_SHARE = 0.5
STEPS = 4
#: Documents a group needs for an estimate of its own.
LEAST = 200
#: Spread that no coordinate is held to be below; the vector's coordinates, in order. A share
#: that can reach 1 needs a floor under 1 / sqrt(61.3) = 0.127 to cross the threshold alone;
#: repeated words end at sqrt(0.30), where the base rule rejects.
FLOOR = {"word_length": 0.15, "symbols": 0.035, "repeated_lines": 0.12, "repeated_words": 0.15,
         "capitals": 0.08, "punctuation": 0.06, "digits": 0.10, "echoes": 0.08}
#: Upper tail of the chi-square distribution beyond which a distance is an outlier's.
TAIL = 1e-9
UNIT = 256
#: A normal distribution's spread against its median absolute deviation.
NORMAL_SPREAD = 1 / NormalDist().inv_cdf(0.75)
#: Parts in which the rows of one group meet its estimate.
SALTS = 32

_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(SYMBOLS, dtype=np.uint8)
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS])
_BLANK = np.array([9, 10, 11, 12, 13, 32])


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of `width` words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=len(words))
    if len(code) == len(words):
        return 0
    # The rank of a window of 2k words is that of its halves: exact, by doubling.
    done = 1
    while done < width:
        pair = ids[: len(ids) - done] * (int(ids.max()) + 1) + ids[done:]
        values, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        done *= 2
    twice = counts[ids] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:-width] += twice
    edge[width:] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_counts(text: str | None) -> dict[str, int]:
    raw = (text or "").encode()
    words = raw.split()
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": int(of.sum() - of[128:192].sum() - of[_BLANK].sum()),
        "n_symbols": int(of[_SYMBOL].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_capitals": int(of[_UPPER].sum()),
        "n_letters": int(of[_UPPER].sum() + of[_LOWER].sum()),
        "n_punctuation": int(of[_PUNCT].sum()),
        "n_digits": int(of[_DIGIT].sum()),
        "n_echoes": sum(map(eq, words, words[1:])),  # words that repeat the one before
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_capitals", "n_letters", "n_punctuation", "n_digits", "n_echoes")


def _measure(rows: dict) -> dict:
    found = [text_counts(t) for t in rows["text"]]
    return {**{k: rows[k] for k in ("doc_id", "lang", "source")}, **{k: [x[k] for x in found] for k in COUNTS}}


def vector() -> list[Column]:
    """The transformed statistics, in whole units; shares by their square root, whose spread
    hardly depends on the share."""
    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)))

    length = F.log2(F.greatest(F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(1.0)), F.lit(1.0)))
    found = (length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
             share("n_capitals", "n_letters"), share("n_punctuation", "word_chars"), share("n_digits", "word_chars"), share("n_echoes", "n_words"))
    return [F.round(x * UNIT).alias(f"x{i}") for i, x in enumerate(found)]


DIM = len(FLOOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def chi2_point(tail: float, dim: int) -> float:
    """Where the chi-square distribution leaves `tail` above it (Wilson-Hilferty)."""
    z = -NormalDist().inv_cdf(tail)
    return dim * (1 - 2 / (9 * dim) + z * math.sqrt(2 / (9 * dim))) ** 3


def _estimates(batches):
    """centre and inverse scatter from a group's sums; `core2` sets the scale: the distance
    within which the core lies against where chi-square puts that share."""
    floor = np.diag((np.array(list(FLOOR.values())) * UNIT) ** 2)
    for rows in batches:
        out = []
        for _, r in rows.iterrows():
            n = r["n"]
            mean = np.array([r[f"s{i}"] for i in range(DIM)]) / n
            cov = np.zeros((DIM, DIM))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
            out.append((r["pool"], mean.tolist(), np.linalg.inv(cov + floor).ravel().tolist()))
        yield pd.DataFrame(out, columns=["pool", "centre", "inverse"])


def _with_sums(grouped):
    x = [F.col(f"x{i}") for i in range(DIM)]
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(DIM)],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in PAIRS],
    )


def _distance2() -> Column:
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + d[i] * d[j] * F.col("inverse")[i * DIM + j] * (1.0 if i == j else 2.0)
    return total


def _bin(distance2: Column) -> Column:
    """Bins of about a ninth of a power of two; few, whatever the distances."""
    return F.floor(F.log2(1 + distance2) * 8).cast("int")


def _core(binned: DataFrame, share: float) -> DataFrame:
    """The nearest bins of each group that hold at least `share` of it."""
    sums = [c for c in binned.columns if c not in ("pool", "salt", "bin")]
    binned = binned.groupBy("pool", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    order = Window.partitionBy("pool").orderBy("bin")
    return (
        binned.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all", F.sum("n").over(Window.partitionBy("pool")))
        .filter(F.col("before") < F.ceil(F.col("all") * share))
    )


def _add_up(core: DataFrame) -> DataFrame:
    names = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}_{j}" for i, j in PAIRS]]
    return core.groupBy("pool").agg(*[F.sum(c).alias(c) for c in names])


def _estimate(sums: DataFrame) -> DataFrame:
    return materialize(sums.mapInPandas(_estimates, "pool string, centre array<double>, inverse array<double>"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians as the first centre, floors and median absolute deviations as the first scatter:
    both hold until half of a group is outliers (quartile distances, until a quarter). The
    coordinates are whole numbers within a known range, so exact medians hold few values."""
    def medians(table: DataFrame, value: Callable[[int], Column], name: str) -> DataFrame:
        found = table.groupBy("pool").agg(*[F.percentile(value(i), F.lit(0.5)).alias(f"m{i}") for i in range(DIM)])
        return materialize(found.select("pool", F.array(*[F.col(f"m{i}") for i in range(DIM)]).alias(name)))

    centres = medians(rows, lambda i: F.col(f"x{i}"), "centre")
    away = rows.join(_for_all(centres), ["pool", "salt"])
    spreads = medians(away, lambda i: F.abs(F.col(f"x{i}") - F.col("centre")[i]), "spread")
    floor = [f * UNIT for f in FLOOR.values()]
    inverse = [
        1 / (F.pow(F.col("spread")[i] * NORMAL_SPREAD, 2) + floor[i] ** 2) if i == j else F.lit(0.0)
        for i in range(DIM) for j in range(DIM)
    ]
    return materialize(centres.join(spreads, "pool").select("pool", "centre", F.array(*inverse).alias("inverse")))


def _for_all(estimates: DataFrame) -> DataFrame:
    """The estimates once per salt: rows of one group meet them in many tasks."""
    return estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _pools(measured: DataFrame, least: int) -> DataFrame:
    """lang, source and the name of the group whose estimate holds for them."""
    sizes = measured.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least
    by_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    own = sizes.select(
        "lang", "source",
        F.when(~small, F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}))
        .when(by_lang >= least, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}))
        .otherwise(F.lit("rest")).alias("pool"),
    )
    return materialize(own)


def judge_quality(docs: DataFrame, least: int = LEAST, share: float = CORE_SHARE, steps: int = STEPS,
                  tail: float = TAIL) -> DataFrame:
    """Counts, base_failed, distance2 and kept of every document."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]]
    counted = map_batches(docs.select(*columns), _measure, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = materialize(counted.select("*", failed.alias("base_failed"), *vector()))
    pools = _pools(measured, least)
    joined = measured.alias("m").join(
        pools.alias("p"), F.col("m.lang").eqNullSafe(F.col("p.lang")) & F.col("m.source").eqNullSafe(F.col("p.source")), "left"
    ).select("m.*", "p.pool", F.pmod(F.xxhash64("m.doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    pooled = materialize(joined)
    rows = pooled.filter(~F.col("base_failed"))
    enough = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least).select("pool")
    rows = rows.join(enough, "pool", "left_semi").select("pool", "salt", *[f"x{i}" for i in range(DIM)])
    now = _start(rows)
    for _ in range(steps):
        binned = _with_sums(rows.join(_for_all(now), ["pool", "salt"]).withColumn("bin", _bin(_distance2())).groupBy("pool", "salt", "bin"))
        now = _estimate(_add_up(_core(binned, share)))
    # The core's scatter is too small by construction; the scale puts its edge where the
    # chi-square distribution has it, and never shrinks.
    binned = rows.join(_for_all(now), ["pool", "salt"]).groupBy("pool", "salt", _bin(_distance2()).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = _core(binned, share)
    scale = edge.groupBy("pool").agg(F.greatest(
        (F.pow(2.0, (F.max("bin") + 1) / 8.0) - 1) / chi2_point(1 - share, DIM), F.lit(1.0)).alias("scale"))
    final = materialize(now.join(scale, "pool"))
    far = F.col("distance2") > chi2_point(tail, DIM)
    return (
        pooled.join(_for_all(final), ["pool", "salt"], "left")
        .withColumn("distance2", _distance2() / F.col("scale"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "distance2")
    )
