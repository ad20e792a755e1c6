"""Embedding tables: load, check, split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions.predicates import Filters, apply_membership_filters, quoted
from vectorlens.functions.vectors import VECTOR


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; a column missing from a part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet(spark: SparkSession, path: str | list[str], merge_schema: bool = False) -> DataFrame:
    """A file, a flat or Hive-partitioned directory, or several of them."""
    if isinstance(path, str):
        return spark.read.option("mergeSchema", merge_schema).parquet(path)
    return union_parts([read_parquet(spark, p, merge_schema) for p in path])


def require_columns(df: DataFrame, id_col: str, vec_col: str) -> None:
    missing = [c for c in (id_col, vec_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if not isinstance(df.schema[vec_col].dataType, T.ArrayType):
        raise ValueError(f"{vec_col!r} is not a vector column: {df.schema[vec_col].dataType.simpleString()}")


def load_statistics(df: DataFrame, vec_col: str = "emb") -> DataFrame:
    """Row count, vectors missing, and the smallest and largest vector width, in one scan."""
    width = F.size(quoted(vec_col))
    present = quoted(vec_col).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~present).alias("n_missing"),
        F.min(F.when(present, width)).alias("dim_min"),
        F.max(F.when(present, width)).alias("dim_max"),
    )


def check_loaded(df: DataFrame, id_col: str = "uuid", vec_col: str = "emb", unique_ids: bool = False) -> int:
    """Width of the vectors. Empty tables, missing vectors, mixed widths and, on request, repeated ids fail."""
    stats = load_statistics(df, vec_col).first()
    if stats["n_rows"] == 0:
        raise ValueError("the table has no rows")
    if stats["n_missing"]:
        raise ValueError(f"{stats['n_missing']} rows have no vector")
    if stats["dim_min"] != stats["dim_max"]:
        raise ValueError(f"vectors have mixed widths {stats['dim_min']}..{stats['dim_max']}")
    if unique_ids:
        check_unique(df, id_col)
    return stats["dim_max"]


def check_unique(df: DataFrame, id_col: str = "uuid") -> None:
    repeated = df.groupBy(quoted(id_col)).count().filter("count > 1").take(1)
    if repeated:
        raise ValueError(f"id {repeated[0][0]!r} occurs {repeated[0][1]} times")


def with_checked_vectors(df: DataFrame, vec_col: str, width: int) -> DataFrame:
    """A missing vector, or one of another width, ends the first job that reads the vectors; no scan of its own."""
    vector = quoted(vec_col)
    wrong = F.concat(F.lit(f"vectors have mixed widths: {width} and "), F.size(vector).cast("string"))
    checked = (
        F.when(vector.isNull(), F.raise_error(F.lit("a row has no vector")))
        .when(F.size(vector) != width, F.raise_error(wrong))
        .otherwise(vector)
    )
    return df.withColumn(vec_col, checked)


def load_embeddings(
    spark: SparkSession,
    path: str | list[str],
    id_col: str = "uuid",
    vec_col: str = "emb",
    filters: Filters | None = None,
    validate: bool = True,
    unique_ids: bool = False,
) -> DataFrame:
    """Read a table of id, vector and metadata. ``filters`` are the batch kind: membership, strict names.

    With ``validate``, an empty table is refused here, and missing vectors or mixed widths by the first job that reads
    the vectors: the check is part of its plan. Only one row is read before. Repeated ids are looked for on request, by a
    job over the ids. :func:`check_loaded` checks everything at once.
    """
    df = read_parquet(spark, path)
    require_columns(df, id_col, vec_col)
    df = apply_membership_filters(df, filters or {})
    if not validate:
        return df
    first = df.select(F.size(quoted(vec_col)), quoted(vec_col).isNull()).take(1)
    if not first:
        raise ValueError("the table has no rows")
    if first[0][1]:
        raise ValueError("a row has no vector")
    if unique_ids:
        check_unique(df, id_col)
    return with_checked_vectors(df, vec_col, first[0][0])


def metadata_only(df: DataFrame, vec_col: str = "emb") -> DataFrame:
    """Everything but the vector, which the scan then skips."""
    return df.drop(vec_col)


def vectors_only(df: DataFrame, id_col: str = "uuid", vec_col: str = "emb") -> DataFrame:
    """Id and float vector."""
    require_columns(df, id_col, vec_col)
    return df.select(quoted(id_col), quoted(vec_col).cast(VECTOR).alias(vec_col))


def vector_elements(df: DataFrame, id_col: str = "uuid", vec_col: str = "emb") -> DataFrame:
    """``(id, pos, value)`` long form of the vectors."""
    return vectors_only(df, id_col, vec_col).select(quoted(id_col), F.posexplode(quoted(vec_col)).alias("pos", "value"))
