"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.session import cut_lineage


# Edges that one task joins in memory: up to so many there is nothing left to exchange between tasks.
EDGES_PER_TASK = 200_000


def _roots(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """Union-find over the edges of some batches: each of their nodes with the least node it reaches there."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for a, b in zip(frame["u"], frame["v"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"])


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges by itself."""
    for frame in frames:
        yield _roots([frame])


def _contract_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All batches of a task together."""
    yield _roots(frames)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the least node around it."""
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node of an edge; ``comp`` is the least node it reaches.

    Nodes are longs or binaries without nulls. Edges are first contracted batch by batch. If at most ``EDGES_PER_TASK``
    are left, one task joins them, without an exchange. Otherwise two star steps alternate until nothing changes; every
    round is cut by a reliable checkpoint, and goes on by that task once few enough edges are left. Only counts reach the
    driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    current = cut_lineage(pairs.mapInPandas(_contract, pairs.schema))
    state = _state(current)
    while state[0]:
        if state[0] <= EDGES_PER_TASK:
            current = cut_lineage(current.coalesce(1).mapInPandas(_contract_all, pairs.schema))
            break
        current = cut_lineage(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if state == before:
            break
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return ends.unionByName(ends.select(F.col("comp").alias("node"), "comp").distinct())
