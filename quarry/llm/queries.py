"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, hmm, packing, pii, quality, simhash_dedup, token_histogram, url_filter, warc
from .common import shared_path, staged, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: the histogram is read for the block totals and for the sums within blocks
    return token_histogram.length_table(staged(token_histogram.length_histogram(table(spark, sf_dir, "documents")), "lengths"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame(url_filter.LIST, "pattern string, day string, action string")
    return url_filter.judge(url_filter.captured(table(spark, sf_dir, "pages")), events)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_pairs(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return staged(warc.write_warc(pages, shared_path(spark, "warc")), "warc-index")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_pairs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_hmm": op8_hmm,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
}

ORACLE = {
    "op4_url_filter": url_filter.oracle(),
    "op6_exact_dedup": """
        SELECT d.doc_id AS doc_id, g.kept_id AS kept_id
        FROM documents d JOIN (SELECT text, min(doc_id) AS kept_id FROM documents WHERE text IS NOT NULL GROUP BY text) g ON d.text = g.text
        WHERE d.doc_id <> g.kept_id
    """,
}
