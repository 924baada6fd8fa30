"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
Quality rules and toxicity decide by doc_id: if one row of an id is rejected, all are; so are
rows without one. Of near-duplicates the stage decides row by row. A null text is an empty one,
an empty table gives an empty one at every stage, and columns beside those of documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailhound.llm import packing, pii, quality, simhash, toxicity
from trailhound.llm.common import read_table
from trailhound.session import materialize

#: No stage's method (robust estimates, a fitted model, XXH64 bits, tokenizer ids) can be said in SQL.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their group go."""
    return _without(docs, quality.judge_quality(docs).filter("NOT kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from labelled documents of this stage."""
    found = toxicity.toxicity(docs, read_table(spark, sf_dir, "labels"))
    return _without(docs, found.filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: one with the least id (a missing id comes
    last), then the least fingerprint. Rows are told by 128 bits of id and text, so rows of one id with
    different texts are each held against their own group. Null texts form a group with
    wordless ones; other columns are carried along."""
    keys = ["_row_1", "_row_2"]
    named = docs.withColumns({key: F.xxhash64(F.lit(i), "doc_id", "text") for i, key in enumerate(keys)})
    found = simhash.classes(named, keys=keys)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", *keys)).alias("r")
    stays = found.groupBy("class_fp").agg(first).select(*[f"r.{key}" for key in keys])
    return named.join(stays, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
