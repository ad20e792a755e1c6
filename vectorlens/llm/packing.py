"""Sharding by best-fit-decreasing packing of indivisible groups.

Texts that are equal form one group. Groups are placed in order of size, largest first, each into the bin with the
tightest room that still holds it. Bins are found in a balanced tree by their remaining room. Equal groups are
placed as one run: after the first, the same bin is the tightest again until it is full, so a run costs one step per
bin it touches. Only the histogram of group sizes reaches the driver. Sizes up to ``EXACT`` bytes are exact; above,
a size is rounded up by at most one part in ``STEPS``, so the histogram has at most ``EXACT + STEPS * 64`` rows
whatever the input, and a bin never holds more than its capacity.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import bucket_count, kept, numbered

EXACT = 4096
STEPS = 1024


class RoomTree:
    """A treap of ``(room, bin)``, ordered by room: insert, remove, and the least entry with enough room."""

    @dataclass
    class _Node:
        key: tuple[int, int]
        rank: float
        left: RoomTree._Node | None = field(default=None)
        right: RoomTree._Node | None = field(default=None)

    def __init__(self):
        self._root = None
        self._random = random.Random(7)

    def _split(self, node, key):
        """Entries below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, above = self._split(node.right, key)
            return node, above
        below, node.left = self._split(node.left, key)
        return below, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low.rank < high.rank:
            low.right = self._merge(low.right, high)
            return low
        high.left = self._merge(low, high.left)
        return high

    def insert(self, room: int, place: int) -> None:
        below, above = self._split(self._root, (room, place))
        self._root = self._merge(self._merge(below, self._Node((room, place), self._random.random())), above)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least room that holds ``size``."""
        below, above = self._split(self._root, (size, -1))
        if above is None:
            self._root = below
            return None
        node = above
        while node.left is not None:
            node = node.left
        least, above = self._split(above, (node.key[0], node.key[1] + 1))
        self._root = self._merge(below, above)
        return least.key


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Place ``(size, count)`` runs into bins of one capacity; ``(size, bin, count)`` in the order placed.

    A run of equal groups fills a bin before it goes to the next. None if more than ``most`` bins are needed, or a
    group exceeds the capacity.
    """
    tree, bins, placed = RoomTree(), 0, []
    for size, count in sorted(runs, reverse=True):
        if size > capacity:
            return None
        while count:
            hit = tree.pop_tightest(size)
            if hit is None:
                if bins == most:
                    return None
                hit = (capacity, bins)
                bins += 1
            room, place = hit
            fit = min(count, room // size)
            placed.append((size, place, fit))
            count -= fit
            tree.insert(room - fit * size, place)
    return placed


def pack_into(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The packing into ``bins`` bins with the least capacity found by bisection, so that sizes come near equal.

    The search starts from the mean size or the largest group, whichever is more, and stops at one part in a million.
    """
    if not runs:
        return []
    total = sum(s * c for s, c in runs)
    low = max(-(-total // bins), max(s for s, _ in runs))
    found = best_fit_decreasing(runs, low, bins)
    if found is not None:
        return found
    step, high = max(1, low // 1_000_000), low
    while found is None:
        high += step
        step *= 4
        found = best_fit_decreasing(runs, high, bins)
    while high - low > max(1, low // 1_000_000):
        middle = (low + high) // 2
        trial = best_fit_decreasing(runs, middle, bins)
        if trial is None:
            low = middle
        else:
            high, found = middle, trial
    return found


def size_class(size):
    """Size as packed: exact up to EXACT, then rounded up to one part in STEPS (column expression)."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 10), F.lit(1.0))
    return F.when(size <= EXACT, size).otherwise((F.ceil(size / step) * step).cast("long"))


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, group_key, shard, slot.

    Give ``shards`` for that many shards as equal as the groups allow, or ``capacity`` (bytes) for as few shards
    of that capacity as best fit finds. Size is the UTF-8 length plus 1; a null text has length 0 and forms one group
    with other nulls, apart from empty texts. A group larger than a shard's share fills a shard alone or nearly so.
    ``slot`` numbers the rows of a shard without gaps. Null and repeated ids, and whole repeated rows, are rows like
    any others. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.lit("+")), F.md5(text))
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), key.alias("group_key"))
    rows = kept(rows, "shard-rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    groups = kept(groups.withColumn("packed", size_class(F.col("bytes"))), "shard-groups")
    histogram = [tuple(r) for r in groups.groupBy("packed").agg(F.count(F.lit(1))).collect()]
    n_groups = sum(c for _, c in histogram)
    if capacity is None:
        placed = pack_into(histogram, shards)
    else:
        placed = best_fit_decreasing(histogram, max([capacity, *(s for s, _ in histogram)]))
    session = docs.sparkSession
    # At most one row per size class and touched bin: bounded by the histogram, so it may be broadcast.
    runs, ends = {}, {}
    for packed, place, count in placed:
        ends[packed] = ends.get(packed, 0) + count
        runs.setdefault(packed, []).append((ends[packed], place))
    table = session.createDataFrame([(s, r) for s, r in runs.items()], "packed long, runs array<struct<upto long, shard int>>")
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(bucket_count(n_groups))).cast("int"))
    ranked = numbered(dealt, ["packed"], "bucket", [F.col("group_key")], {"rank": F.lit(1)})
    shard = F.filter("runs", lambda r: r.upto > F.col("rank"))[0].shard
    # A full sort inside the class is not needed: groups of one class are interchangeable.
    homes = ranked.join(F.broadcast(table), "packed").select("group_key", shard.alias("shard"))
    placed_rows = rows.join(homes, "group_key")
    n_rows = rows.count()
    order = F.xxhash64("doc_id", "group_key")
    dealt = placed_rows.withColumn("at", order).withColumn("bucket", F.pmod("at", F.lit(bucket_count(n_rows))).cast("int"))
    slots = numbered(dealt, ["shard"], "bucket", [F.col("at"), F.col("doc_id"), F.col("group_key")], {"slot": F.lit(1)})
    return slots.select("doc_id", "size", "text_crc32", "group_key", "shard", F.col("slot").cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of :func:`shard_documents` under the law of near equal bytes."""
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
