"""Queries of the training-data operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import p1_new_text, p2_personal, p3_main_text, p4_residue, p5_entities, p6_survivor, p7_truncation
from missive.llm import p8_encode, p9_pack, p10_canonical
from missive.runtime import balanced, durable
from missive.runtime import table as stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stored table; one that comes as a single small file is spread over the cores."""
    return balanced(stored(spark, d, name))


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_new_text.found(table(spark, d, "message"))


def _p1_new_text(spark: SparkSession, d: str) -> DataFrame:
    return p1_new_text.newly_written(table(spark, d, "message")).select("id", "new_body").distinct()


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_personal.found(table(spark, d, "message"), table(spark, d, "outreach"))


def _p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return p2_personal.redacted(table(spark, d, "message"), table(spark, d, "outreach"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_main_text.found(table(spark, d, "job"))


def _p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    job = table(spark, d, "job")
    cleaned = p3_main_text.clean_site_pages(p4_residue.job_records(job)).select(F.col("rec_id").try_cast("bigint").alias("id"), "main_text")
    blank = job.where("description IS NULL OR trim(description) = ''").select("id", F.trim("description").alias("main_text"))
    return cleaned.unionByName(blank)


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_residue.found(table(spark, d, "job"), table(spark, d, "scraped_job"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "application"), table(spark, d, "job"), table(spark, d, "outreach")


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_entities.found(*_names(spark, d))


def _p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    linked = p5_entities.resolve(p5_entities.company_names(*_names(spark, d)))
    least = linked.groupBy("cluster").agg(F.min("name").alias("entity"), F.count("*").alias("n_spellings"))
    return linked.join(least, "cluster").select("name", "entity", "n_spellings")


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """job, ids of unusable descriptions, trust and groups; only grouped rows are judged."""
    job = table(spark, d, "job")
    member = durable(p6_survivor.groups(job))
    ids = member.select("id")
    asked = ids.select(F.col("id").cast("string").alias("rec_id"))
    residue = p4_residue.residue(p4_residue.job_records(job), asked).select(F.col("rec_id").try_cast("bigint").alias("id"))
    return job, residue.unionByName(p7_truncation.cut_descriptions(job, ids)), table(spark, d, "source_trust"), member


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_survivor.found(*_grouped(spark, d))


def _p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return p6_survivor.merged(*_grouped(spark, d))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_truncation.found(table(spark, d, "job"), table(spark, d, "message"))


def _p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return p7_truncation.rates(table(spark, d, "job"), table(spark, d, "message"))


def _p7_signs(spark: SparkSession, d: str) -> DataFrame:
    return p7_truncation.signs(table(spark, d, "job"), table(spark, d, "message"))


def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8_encode.encode_corpus(table(spark, d, "documents")).select("doc_id", "ids")


def _p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return p9_pack.pack(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def _p9_report(spark: SparkSession, d: str) -> DataFrame:
    return p9_pack.pack_report(_p9_pack(spark, d), table(spark, d, "pack_capacity"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_canonical.look_alikes(table(spark, d, "documents"))


def _p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return p10_canonical.canonical_corpus(table(spark, d, "documents")).select("doc_id", "canonical")


def _p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return p10_canonical.classes(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_new_text": _p1_new_text,
        "p2_found": _p2_found,
        "p2_redacted": _p2_redacted,
        "p3_found": _p3_found,
        "p3_main_text": _p3_main_text,
        "p4_found": _p4_found,
        "p5_found": _p5_found,
        "p5_clusters": _p5_clusters,
        "p6_found": _p6_found,
        "p6_consensus": _p6_consensus,
        "p7_found": _p7_found,
        "p7_rates": _p7_rates,
        "p7_signs": _p7_signs,
        "p8_ids": _p8_ids,
        "p9_pack": _p9_pack,
        "p9_report": _p9_report,
        "p10_found": _p10_found,
        "p10_canonical": _p10_canonical,
        "p10_classes": _p10_classes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": p7_truncation.found_sql(spark=False),
        "p7_rates": p7_truncation.rates_sql(spark=False),
        "p7_signs": p7_truncation.signs_sql(spark=False),
    }
