"""A corpus pipeline: each stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalume.llm import decontamination, language_id, ngram_join, packing, secrets
from catalume.llm.common import documents, left, release, table, written
from catalume.llm.queries import BYTE_BPE, PIECES, WORDS, remainder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those that the operator rejects go."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(remainder(4) != 2), PIECES))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.mask_secrets(docs, words_file=WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.digest(packing.pack(docs, BYTE_BPE, 1024, 0))


STAGES = [("language", identify_language), ("near_copies", drop_near_copies), ("leaks", drop_benchmark_leaks), ("secrets", mask_secrets), ("packing", pack)]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result but the last written to the shared folder and read again.

    What a stage has left in the shared folder goes when its result is written. Rows with null
    or empty text go with the first stage, as their language cannot be told; rows with null
    doc_id are never copies of each other and stay, and rows that repeat a doc_id count as
    copies. Columns beyond those of documents travel along to the last stage. An empty table
    gives no rows.
    """
    docs, before = documents(spark, sf_dir), left(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            release(spark, docs, before)
    return docs
