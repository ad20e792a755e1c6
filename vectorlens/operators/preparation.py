"""Vector preparation as table operators: normalized columns, the preparation report, memory estimates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted

FEATURES = "__features"


def with_prepared(df: DataFrame, vec_col: str = "emb", name: str | None = None) -> DataFrame:
    return df.withColumn(name or vec_col, vectors.prepare(quoted(vec_col)))


def with_features(df: DataFrame, vec_col: str, normalize: bool = True) -> DataFrame:
    """Add the MLlib vector column; the batch job clusters raw vectors, the apps normalized ones."""
    vector = vectors.prepare(quoted(vec_col)) if normalize else quoted(vec_col).cast(vectors.VECTOR)
    return df.withColumn(FEATURES, array_to_vector(vector))


def report(df: DataFrame, vec_col: str = "emb") -> DataFrame:
    """Row count, width, replaced elements, near-zero norms and norm statistics, in one pass."""
    checked = df.select(quoted(vec_col).alias("v")).select(
        F.size("v").alias("width"), vectors.quality(F.col("v")).alias("q")
    )
    norm = F.col("q.norm")
    return checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("width").alias("d"),
        F.sum("q.nonfinite").alias("n_nonfinite"),
        F.count_if(norm < vectors.MIN_NORM).alias("n_near_zero"),
        F.min(norm).alias("norm_min"),
        F.max(norm).alias("norm_max"),
        F.avg(norm).alias("norm_mean"),
    )


def memory_mb(n: Column, d: Column, method: str) -> Column:
    """Truncated estimate in MB of projecting n vectors of width d on one machine."""
    mb = 1024.0 * 1024.0
    n, d = n.cast("double"), d.cast("double")
    base = n * d * 4 / mb
    estimates = {
        "PCA": base * 2,
        "TSNE": base * 4 + n * n * 4 / mb,
        "UMAP": base * 3 + n * 15 * 4 / mb,
    }
    return estimates.get(method.upper(), base * 3).cast("long")


def memory_estimate(df: DataFrame, vec_col: str = "emb", methods: tuple[str, ...] = ("PCA", "TSNE", "UMAP")) -> DataFrame:
    """``(method, mb)`` for the table at hand; the explorer warns above 1000 MB."""
    sized = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(quoted(vec_col))).alias("d"))
    pairs: list[Column] = []
    for method in methods:
        pairs += [F.lit(method), memory_mb(F.col("n"), F.col("d"), method)]
    return sized.select(F.stack(F.lit(len(methods)), *pairs).alias("method", "mb"))
