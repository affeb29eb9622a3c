"""A corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm import jaccard_join, packing, pii, quality_rules, storage, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL: perplexity, components and branch and bound are iterative.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own text: null and repeated ids make no difference."""
    return quality_rules.kept_rows(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows without an id or without words stay, and rows that repeat an id and its text stay together."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a window of 20 words covers which also starts earlier; emptied ones stay, empty, and null texts stay null."""
    changed = substring_dedup.shortened(docs)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each span of personal data, one row for each row."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_copies), ("substring_dedup", repeated_passages), ("pii", personal_data), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
