"""A corpus pipeline: known language, one of each near copy, no benchmark passages, mixed sources, token files.

Each stage works on all rows that the stage before it kept. Between two stages the rows are written to the shared
folder and read again, so that a later stage never repeats an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorlens.llm import decontaminate, language, mixing, ngram_join, token_files
from vectorlens.llm.tables import kept


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digest(docs, token_files.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``: doc_id, start, n_tokens, ids_crc32 of the files written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained vectors, a randomised decomposition and a tokenizer decide on rows: SQL cannot express the stages.
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
