"""Registered queries: every operator over the whole given tables, with its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from vectorlens.catalog import evaluation, filters, graphs, profiles, records, sources, taxonomy, vectors

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (sources, filters, profiles, records, vectors, evaluation, taxonomy, graphs):
        found.update(module.QUERIES)
    return found
