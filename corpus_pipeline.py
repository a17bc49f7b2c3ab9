"""Cleans and packs a corpus: toxicity, language ID, near duplicates, packing.

Every stage works on all rows that its predecessor kept, written as Parquet and read again in between. The first three
return the columns of documents; the last returns the packed pieces with their ids.

Null texts are scored as empty ones, go where a language must be told, and count as empty in the last two stages; null ids are
kept; long texts are read whole; columns beyond those of documents pass through; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import language_id, ngram_join, packing, toxicity
from framewright.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the labelled ones among them. Repeated rows share a fate."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter, or without a likely language, go. Ties go to the language that sorts first."""
    return language_id.keep(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate class; of rows that repeat it, one."""
    return ngram_join.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, packed into windows; repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unidentified), ("ngram_join", drop_near_duplicates), ("packing", pack)]
#: No stage but the joins can be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
