"""Corpus preparation in stages over ``documents``; belongs to agrarium.llm.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``
but for the last, which returns token digests of the documents that are left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.llm import op1_decontaminate, op3_byte_bpe, op4_simhash_dedup, op6_line_dedup, op10_language_id
from agrarium.llm.rows import saved


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go; lang is what the others are found to be in."""
    return op10_language_id.accepted(docs, most_docs=40, most_chars=120_000)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters that stand in 5 documents stay in the last one only; n_chars follows the text."""
    kept = op6_line_dedup.deduplicated(docs, least=40, documents=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return op4_simhash_dedup.representatives(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return op1_decontaminate.decontaminated(docs, benchmark, size=5, similarity=0.8, radius=23, short=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return op3_byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("byte_bpe", encode)]
#: SQL can't express the stages; tests/llm/test_pipeline_brute.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
