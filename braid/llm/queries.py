"""Queries over the documents, each through its operator, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import decontam, feistel_shards, jaccard_join, kn_quality, license_scan, line_quality, packing, ppm_langid, token_counts, toxicity
from braid.llm.common import table
from braid.llm.oracles import ORACLES


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op4_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_documents(table(spark, sf_dir, "documents"))


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ppm_langid.fit(docs, ppm_langid.bucket(F.col("doc_id")) != 1)
    return ppm_langid.identify(docs, model).select("doc_id", (ppm_langid.bucket(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return out.select("doc_id", "contaminated", items.alias("item_ids"), F.size(items).cast("long").alias("n_items"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.bucket(F.col("doc_id")) != 1)
    out = toxicity.score_documents(docs, grammar)
    return out.select("doc_id", (toxicity.bucket(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted", F.size("clauses").cast("long").alias("n_clauses"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shard_documents(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "license", "coverage", F.size("matches").cast("long").alias("n_matches"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_best_fit_packing, op3_jaccard_join, op4_kn_quality, op5_line_quality, op6_ppm_language, op7_decontamination, op8_toxicity, op9_feistel_shards, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
