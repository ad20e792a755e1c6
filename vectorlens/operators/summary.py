"""Cluster summary and representatives."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators.clustering import MAX_CENTER_BYTES


def cluster_summary(df: DataFrame, label_col: str, vec_col: str = "emb") -> DataFrame:
    """``Cluster, Count, Variance``: mean squared distance to the cluster mean, over the vectors as given.

    One pass. The summarizer merges running means and squared deviations, so there is no cancellation and
    no second scan against the means; its unbiased variance is scaled back to the population form.
    """
    metrics = Summarizer.metrics("count", "variance").summary(array_to_vector(quoted(vec_col)))
    grouped = df.groupBy(quoted(label_col).alias("Cluster")).agg(metrics.alias("m"))
    count = F.col("m.count")
    spread = F.aggregate(vector_to_array("m.variance"), F.lit(0.0), lambda total, v: total + v)
    return grouped.select(
        "Cluster", count.alias("Count"), F.round(spread * (count - 1) / count, 3).alias("Variance")
    )


def label_means(df: DataFrame, label_col: str, vec_col: str = "emb") -> DataFrame:
    """``(label, mean)``: mean vector per label, combined map-side."""
    means = df.groupBy(quoted(label_col)).agg(Summarizer.mean(array_to_vector(quoted(vec_col))).alias("mean"))
    return means.withColumn("mean", vector_to_array("mean"))


def with_center_distance(df: DataFrame, label_col: str, vec_col: str = "emb", name: str = "dist2") -> DataFrame:
    """Add each row's squared distance to the mean of its cluster.

    The means go to every task while they are small; a label column with too many values is joined instead.
    """
    means = df.groupBy(quoted(label_col).cast("string").alias("__name")).agg(
        Summarizer.mean(array_to_vector(quoted(vec_col))).alias("__mean")
    )
    label = quoted(label_col).cast("string")
    first = df.select(quoted(vec_col)).filter(quoted(vec_col).isNotNull()).head(1)
    width = max(1, len(first[0][0])) if first else 1
    allowed = MAX_CENTER_BYTES // (8 * width)
    found = means.filter(F.col("__name").isNotNull()).take(allowed + 1)
    if len(found) <= allowed:
        centers = np.array([r["__mean"].toArray() for r in found])
        distance = vectors.distance2_to_own(quoted(vec_col), label, [r["__name"] for r in found], centers)
        return df.filter(label.isNotNull()).withColumn(name, distance)
    arrays = means.withColumn("__mean", vector_to_array("__mean"))
    joined = df.withColumn("__name", label).join(arrays, "__name")
    return joined.withColumn(name, vectors.distance2(quoted(vec_col), F.col("__mean"))).drop("__name", "__mean")


def representatives(
    df: DataFrame, label_col: str, id_col: str = "uuid", vec_col: str = "emb", n: int = 3
) -> DataFrame:
    """``(cluster, rank, id, dist2)``: the n rows nearest to each cluster mean, ties by id.

    The rank limit is applied before the shuffle, so a task emits at most n rows per cluster.
    """
    near = with_center_distance(df.select(quoted(label_col), quoted(id_col), quoted(vec_col)), label_col, vec_col)
    order: list[Column] = [F.col("dist2"), quoted(id_col)]
    slim = near.select(quoted(label_col).alias("cluster"), quoted(id_col), "dist2")
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).select("cluster", "rank", quoted(id_col), "dist2")
