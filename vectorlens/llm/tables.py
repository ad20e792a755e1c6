"""Tables written for later steps of an operator, and row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.session import fresh_path

# Rows that one task numbers in a window.
ROWS_PER_BUCKET = 50_000
BROADCAST_KEYS = 500_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that survive executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_text_key(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, text_key)``; the key tells rows apart that repeat an id with another text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``(doc_id, text_key)`` is not among ``keys``, all columns kept.

    Up to ``BROADCAST_KEYS`` keys are sent to every task (about 40 bytes each); beyond, texts move in a shuffle join.
    """
    gone = kept(keys.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct(), "gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("row"))
    same = (F.xxhash64("row.text") == F.col("__k")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("__d"))
    return rows.join(gone, same, "left_anti").select("row.*")


def first_by_hash(rows: DataFrame, column: str, most: int) -> DataFrame:
    """``(column)``: at most ``most`` distinct strings of a column, those first in hash order, nulls left out.

    Tasks hand on hashes only; the strings themselves are fetched for the hashes chosen.
    """
    named = rows.select(column, F.xxhash64(column).alias("h")).filter(F.col(column).isNotNull())
    chosen = named.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    # No string at all: the test is null and nothing is kept.
    return named.filter(F.col("h") <= F.lit(chosen)).dropDuplicates(["h"]).select(column)


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Add, for every name in ``amounts``, the sum of that amount over the rows that stand before a row.

    Rows of a group are ordered by ``bucket``, then by ``order``. Sums per bucket are added up first, so a window
    only ever holds the buckets of a group or the rows of one bucket, and a group of any size is spread over tasks.
    Group columns may be null.
    """
    from pyspark.sql import Window

    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(a).alias(f"{n}__t") for n, a in amounts.items()])
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *[F.coalesce(F.sum(f"{n}__t").over(earlier), F.lit(0)).alias(f"{n}__b") for n in amounts])
    same = None
    for key in keys:
        test = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        same = test if same is None else same & test
    joined = df.alias("l").join(totals.alias("r"), same).select("l.*", *[f"r.{n}__b" for n in amounts])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"{n}__b")).alias(n) for n, a in amounts.items()]
    return joined.select(*df.columns, *added)
