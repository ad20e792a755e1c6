"""Row numbers in a global order, and ranks inside groups, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.session import cut_lineage


def with_row_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add ``0..n-1``: a range-partitioned sort plus per-partition offsets, all on the JVM side."""
    import pyspark.pandas as ps  # slow to import, and few operators need it

    with ps.option_context("compute.default_index_type", "distributed-sequence"):
        return df.sort(*order).pandas_api().to_spark(index_col=name)


def with_group_rank(df: DataFrame, group: str, order: list[Column], totals: list[Column] | None = None) -> DataFrame:
    """Add ``rank`` (1-based inside each group), ``size`` (rows of the group) and further group totals.

    A ranking window would sort a whole group in one task. Here one global sort, split by ranges, numbers all
    rows, and the number of a group's first row is subtracted. A group with many rows is spread over tasks in
    the sort and, as adaptive execution splits skewed joins, in the lookup of its first row as well.
    """
    numbered = cut_lineage(with_row_index(df, [F.col(group), *order], "__number"))
    starts = numbered.groupBy(group).agg(
        F.min("__number").alias("__first"), F.count(F.lit(1)).alias("size"), *(totals or [])
    )
    # A null group is a group like the others.
    joined = numbered.join(starts.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("rank", F.col("__number") - F.col("__first") + 1).drop("__number", "__first", "__group")


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add a long that no other row has, and checkpoint the rows, so that every later use sees the same keys.

    Operators that bring results back to rows join by it: ids of the caller may repeat or be null.
    """
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
