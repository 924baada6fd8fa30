"""Technique catalogs from a STIX bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailhound.functions.text import parent_technique
from trailhound.operators.catalog import TECHNIQUE

SOURCE_NAME = "mitre-attack"  # fixed value: whose ids and phases count

BUNDLE = (
    """id string, spec_version string,
    objects array<struct<
      type: string, name: string, revoked: boolean, x_mitre_deprecated: boolean,
      modified: string, x_mitre_attack_spec_version: string,
      external_references: array<struct<source_name: string, external_id: string, url: string>>,
      kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>>"""
)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE).json(path, multiLine=True)


def bundle_objects(bundle: DataFrame) -> DataFrame:
    """(id, spec_version, at, o): the objects of a bundle with their places in it."""
    return bundle.select("id", "spec_version", F.posexplode("objects").alias("at", "o"))


def _patterns(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("o.type") == "attack-pattern")


def techniques(objects: DataFrame) -> DataFrame:
    """One row per technique id; of objects sharing an id the last one counts."""
    refs = F.filter("o.external_references", lambda r: r["source_name"] == SOURCE_NAME)
    ids = F.filter(refs, lambda r: F.coalesce(r["external_id"], F.lit("")) != "")
    phases = F.filter(
        "o.kill_chain_phases",
        lambda p: (p["kill_chain_name"] == SOURCE_NAME) & (F.coalesce(p["phase_name"], F.lit("")) != ""),
    )

    def first(items: Column, field: str) -> Column:
        return F.try_element_at(items, F.lit(1))[field]

    rows = _patterns(objects).select(
        "at",
        first(ids, "external_id").alias("technique_id"),
        F.coalesce("o.name", F.lit("")).alias("name"),
        F.coalesce(
            F.transform(phases, lambda p: p["phase_name"]), F.array().cast("array<string>")
        ).alias("tactics"),
        (
            F.coalesce("o.revoked", F.lit(False)) | F.coalesce("o.x_mitre_deprecated", F.lit(False))
        ).alias("deprecated"),
        F.coalesce(first(refs, "url"), F.lit("")).alias("url"),
    ).filter(F.col("technique_id").isNotNull())
    last = rows.groupBy("technique_id").agg(
        F.max_by(F.struct("name", "tactics", "deprecated", "url"), "at").alias("t")
    )
    return last.select(
        "technique_id", "t.name", "t.tactics",
        parent_technique(F.col("technique_id")).alias("parent_id"), "t.deprecated", "t.url",
    )


def catalog_meta(objects: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of counts and version marks; `unknown` where the bundle says nothing."""
    marks = _patterns(objects).agg(
        F.max(F.nullif("o.x_mitre_attack_spec_version", F.lit(""))).alias("spec"),
        F.max(F.nullif("o.modified", F.lit(""))).alias("modified"),
    )
    ident = objects.agg(F.min("spec_version").alias("stix"), F.min("id").alias("bundle"))
    counts = catalog.agg(
        F.count(F.lit(1)).alias("technique_count"),
        F.count_if(~F.col("deprecated")).alias("active_count"),
        F.count_if("deprecated").alias("deprecated_count"),
        F.count_if(F.col("parent_id").isNotNull()).alias("subtechnique_count"),
    )
    one = F.lit(1).alias("one")
    unknown = F.lit("unknown")
    return (
        counts.select("*", one).join(marks.select("*", one), "one").join(ident.select("*", one), "one")
        .select(
            "technique_count", "active_count", "deprecated_count", "subtechnique_count",
            F.coalesce("spec", unknown).alias("attack_spec_version"),
            F.coalesce("modified", unknown).alias("content_last_modified"),
            F.coalesce("stix", unknown).alias("stix_spec_version"),
            F.coalesce("bundle", unknown).alias("bundle_id"),
        )
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Sorted by id; an empty result is refused, it would switch every mapping off."""
    if catalog.isEmpty():
        raise ValueError("the bundle holds no techniques; nothing written")
    catalog.select(*TECHNIQUE.fieldNames()).orderBy("technique_id").write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TECHNIQUE).json(path)
