"""Two-dimensional density grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.functions.bins import Bins, nice_bins
from vectorlens.functions.predicates import quoted


def bin_index(value: Column, bins: Bins) -> Column:
    """Bin number; the upper edge of the range belongs to the last bin."""
    clamped = F.least(value, F.lit(bins.stop - bins.step))
    return F.floor((clamped - F.lit(bins.start)) / F.lit(bins.step) + F.lit(1e-14)).cast("long")


def density_grid(df: DataFrame, x: str = "x", y: str = "y", maxbins: int = 40) -> DataFrame:
    """``(x_bin, y_bin, x_start, y_start, n)`` for occupied cells of a grid with nice edges."""
    if maxbins < 1:
        raise ValueError(f"maxbins must be positive, got {maxbins}")
    points = df.select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"))
    infinite = (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    points = points.filter(~F.isnan("x") & ~F.isnan("y") & ~infinite)
    edges = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    schema = "x_bin long, y_bin long, x_start double, y_start double, n long"
    if edges[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    xs, ys = nice_bins(edges[0], edges[1], maxbins), nice_bins(edges[2], edges[3], maxbins)
    counted = points.groupBy(bin_index(F.col("x"), xs).alias("x_bin"), bin_index(F.col("y"), ys).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        "x_bin",
        "y_bin",
        (F.lit(xs.start) + F.col("x_bin") * F.lit(xs.step)).alias("x_start"),
        (F.lit(ys.start) + F.col("y_bin") * F.lit(ys.step)).alias("y_start"),
        "n",
    )
