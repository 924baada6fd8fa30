"""Document fingerprints: bottom-k sketches of word shingles, DataFrame functions only.

A sketch is the k least distinct hashes of a text's shingles, in order. Two sketches give an
unbiased estimate of resemblance (Broder 1997): of the k least hashes of their union, the
share that both have. The k-th least hash tells how many distinct shingles there are, and both
together containment. Sketches of parts merge by keeping the k least of their union.

Hashes are the upper 60 bits of XXH64 chained over a shingle's words, written as 15 hex
digits each; equal texts have equal fingerprints.

Cases: a null text is empty and its fingerprint is the empty string; two empty fingerprints
resemble each other fully, an empty and another one not at all; fewer words than a shingle
are one shingle; repeated rows stay. Of rows with equal doc_id the next document of the id
before is the one with the least text hash. Rows with a null doc_id have no place in the
order: their own text follows them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailhound.session import materialize

K = 128
WORDS = 5
DIGITS = 15
_SPACE = float(1 << 60)
#: Documents per range of ids, about, when successors are looked up.
RANGE_ROWS = 500_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: as a lambda's variable it is not written
    out again wherever it is used, as a column's expression would be."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """The hash of each shingle, as a whole number of 60 bits."""
    def of(w: Column) -> Column:
        n = F.size(w)
        # Words beyond the end are null, which the hash passes over: a short text is one shingle.
        at = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(size)]), 4)
        return F.when(n == 0, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), at))

    return let(words, of)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = WORDS) -> Column:
    return least(shingle_hashes(words_of(F.coalesce(text, F.lit(""))), size), k)


def to_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def from_text(fingerprint: Column) -> Column:
    n = F.length(fingerprint) / DIGITS
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda i: F.conv(fingerprint.substr(i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"),
    ))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of the k least hashes of the union, the share that both have."""
    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, k), of)


def distinct_shingles(hashes: Column, k: int = K) -> Column:
    """How many distinct shingles a sketch stands for: exact below k."""
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise(
        (k - 1) * F.lit(_SPACE) / F.element_at(hashes, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has too, from resemblance and the sizes: exact where the
    shingles of both together are at most k."""
    return likeness(a, b, k)["contained"]


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """near (resemblance) and contained (of a in b) as one struct; resemblance is worked out once."""
    def of(r: Column) -> Column:
        na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
        share = F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / (1 + r) / na))
        return F.struct(r.alias("near"), share.alias("contained"))

    return let(resemblance(a, b, k), of)


def merge(parts: DataFrame, keys: list[str], hashes: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key. Every task keeps only k hashes per key before they are sent, so a
    key with very many parts is no special case."""
    each = parts.select(*keys, F.explode(hashes).alias("h")).distinct()
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(hashes))


def _neighbours(ids: DataFrame, count: int) -> DataFrame:
    """doc_id, prev_id (before it in ascending order; the last before the first) and wanted,
    how much of the document's text the one before wants."""
    spark = ids.sparkSession
    parts = max(1, -(-count // RANGE_ROWS))
    # Written once, so that the part of a row is the same whenever it is read.
    placed = materialize(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    # One row for half a million documents: where each range ends, and what its last one wants.
    ends = placed.groupBy("part").agg(F.max_by(F.struct("doc_id", "half"), "doc_id").alias("last")).orderBy("part").collect()
    carried = spark.createDataFrame(
        [(e["part"], ends[i - 1]["last"]["doc_id"], ends[i - 1]["last"]["half"]) for i, e in enumerate(ends)],
        "part int, end_id long, end_half long",
    )
    order = Window.partitionBy("part").orderBy("doc_id")
    return placed.withColumn("p", F.lag(F.struct("doc_id", "half")).over(order)).join(carried, "part").select(
        "doc_id", F.coalesce("p.doc_id", "end_id").alias("prev_id"), F.coalesce("p.half", "end_half").alias("wanted"))


def fingerprint_pairs(docs: DataFrame, k: int = K, size: int = WORDS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, their likenesses, how many distinct
    shingles the document has and which share of them the edited text and the next one hold.

    Texts are dealt by id once. There each gives the document before it the piece of text
    that one wants, and its own sketch; only these travel again."""
    # A plain column where no cast is needed: both readers of the texts dealt by id then have
    # the same plan, and Spark shuffles them once.
    ids_are_long = docs.schema["doc_id"].dataType.typeName() == "long"
    doc_id = F.col("doc_id") if ids_are_long else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("long")
    rows = materialize(base.select("doc_id", half.alias("half")).filter("doc_id IS NOT NULL"))
    ids = materialize(rows.groupBy("doc_id").agg(F.max("half").alias("half")))
    unique = ids.count()
    known = base.filter("doc_id IS NOT NULL")
    placed = known.join(materialize(_neighbours(ids, unique)), "doc_id")
    gifts = placed.select(
        F.col("prev_id").alias("doc_id"), F.col("text").substr(F.lit(1), F.col("wanted").cast("int")).alias("head"),
        sketch(F.col("text"), k, size).alias("next_sketch"),
    )
    if rows.count() > unique:  # of rows that share an id, one is the next document
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("head"), "head", F.xxhash64("next_sketch"))
        gifts = gifts.withColumn("order", F.row_number().over(first)).filter(F.col("order") == 1).drop("order")
    followed = known.join(gifts, "doc_id")
    apart = base.filter("doc_id IS NULL").select(
        "doc_id", "text", F.col("text").alias("head"), sketch(F.col("text"), k, size).alias("next_sketch"))
    joined = followed.unionByName(apart).withColumn("n_chars", F.length("text").cast("long")).withColumn("half", half)
    edited = F.concat(
        F.col("text").substr(F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")),
        F.col("head").substr(F.lit(1), F.col("half").cast("int")),
    )
    # What a generator puts out is a column: it is not worked out again by each use.
    made = joined.select("doc_id", "n_chars", "text", "next_sketch", F.explode(F.array(edited)).alias("edited")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_sketch",
        F.explode(F.array(F.struct(
            sketch(F.col("text"), k, size).alias("own"), sketch(F.col("edited"), k, size).alias("edited")))).alias("s"),
    )
    held = made.select(
        "doc_id", "n_chars", "edited_sha256", "s",
        F.explode(F.array(F.struct(
            likeness(F.col("s.own"), F.col("s.edited"), k).alias("edited"), likeness(F.col("s.own"), F.col("next_sketch"), k).alias("next")))).alias("l"),
    )
    return held.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("s.own")).alias("fingerprint"),
        to_text(F.col("s.edited")).alias("edited_fingerprint"),
        F.col("l.edited.near").alias("near_edited"), F.col("l.next.near").alias("near_next"),
        distinct_shingles(F.col("s.own"), k).alias("n_distinct"),
        F.col("l.edited.contained").alias("contained_edited"), F.col("l.next.contained").alias("contained_next"),
    )
