"""A pipeline from raw documents to training windows: language ID, n-gram Jaccard join, benchmark decontamination,
secret scans, packing. Each stage reads what its predecessor wrote; all but the last keep the columns of documents.

Documents without a language that can be told go; of each component of near copies one row stays; documents that hold a
window of a benchmark item go; secrets in texts are replaced by a mark; what is left is packed whole.

Defined results: null and empty texts, and those without a letter, have no language and go; a null lang is filled with the
prediction; of rows that share key and text one stays, and of a component the row of the smallest key (null keys last);
a null source counts as an empty path; n_chars, where there is one, follows the redacted text; very long texts are read
whole at every stage; further columns pass unchanged up to the last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, language, ngram_join, packing, secrets
from quillon.llm._common import read, written
from quillon.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, percent=75)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, path="source" if "source" in docs.columns else None)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("secret_scan", secret_scan), ("windows", windows)]

#: Packing by differencing can't be said in SQL; tests/llm/test_pipeline.py checks run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing makes of the documents, with each stage's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
