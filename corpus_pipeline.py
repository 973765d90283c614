"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import decontam, jaccard_join, line_quality, packing, toxicity
from braid.llm.common import staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar does not reject; it learns from all labelled documents but the held-out third."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.bucket(F.col("doc_id")) != 1)
    return toxicity.clean_documents(docs, grammar)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines."""
    return line_quality.clean_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("quality rules", without_boilerplate), ("n-gram Jaccard join", without_near_copies), ("benchmark decontamination", without_benchmark), ("best-fit packing", packed)]

#: SQL has no tokenizer and no finite-state grammar; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs
