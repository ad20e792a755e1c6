"""Approximate nearest-neighbour graph by refinement: a neighbour of a neighbour is likely to be a neighbour.

The exact graph of :mod:`vectorlens.operators.neighbours` compares all pairs of cells on vectors without structure. Here the
number of comparisons of a row does not depend on the size of the table: each round joins every row's neighbours, and
those rows whose neighbour it is, with one another, and keeps what lies nearer than the lists of the two. Only pairs
with an entry that is new since the last round are compared. The caller chooses between the two graphs; weights and
layouts take either.

Rows are dealt to a few large regions, and a tile is a pair of regions. A round deals each vector once to every tile of its
region, however many lists name it, and the members of each list to the tiles of their regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators import neighbours
from vectorlens.operators.ordering import with_row_key
from vectorlens.operators.projection import prepared
from vectorlens.session import cut_lineage

# Rows that share a block: they are compared at the start.
BLOCK_ROWS = 1024
# Bytes of vectors of a region, about, at most; in a round a vector is dealt once to every pair its region is in. Smaller
# tables have about REGIONS regions of at least so many rows.
REGION_BYTES = 32 * 1024 * 1024
REGIONS, LEAST_ROWS = 6, 1024
ROUNDS = 12
# Refinement ends once a round changes less than this share of all entries.
TOLERANCE = 0.002
# Entries of a list beyond the wanted number: the graph is refined with longer lists and cut at the end.
SPARE = 1.0
# Products held at once while lists are joined, and pairs found before they are ranked.
CELLS = 1 << 21
PAIRS = 1 << 21
# Rows are named by their region and, in the lower bits, their place in it.
PLACE_BITS = 32

_LISTS = "src long, dst array<long>, d2 array<double>"
_STATE = f"{_LISTS}, fresh array<boolean>"
_DEALT = "tile int, region int, first array<int>, second array<int>, sizes array<int>, ends array<double>"


def _lists(src: np.ndarray, dst: np.ndarray, d2: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    return {"src": pa.array(src, pa.int64()), "dst": vectors.as_list_array(dst, sizes), "d2": vectors.as_list_array(d2, sizes)}


def _flat(lists: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated elements of a list array, and the length of each list; a null list has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i]+1, ...`` with ``sizes[i]`` values each, one after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _places(group: np.ndarray) -> np.ndarray:
    """Place of each element inside its run of equal values, for sorted values."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _first_lists(k: int):
    """The ``k`` nearest other rows of each row inside its block."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("key").combine_chunks()
        keys = block["key"].to_numpy()
        points = vectors.as_matrix(block["v"].combine_chunks())
        where, dist = vectors.closest(points, points, k + 1)
        own = where == np.arange(len(points))[:, None]
        # Among many copies a row may be missing in its own list; the last entry goes instead.
        own[~own.any(axis=1), -1] = True
        return pa.table(_lists(keys, keys[where[~own]], dist[~own], np.full(len(keys), where.shape[1] - 1)))

    return run


def _merge(size: int, start: bool):
    """The ``size`` nearest of a row's list and of what was found for it; entries that were not in the list are fresh.

    The row without source goes on with the sum of all numbers of comparisons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pc.is_null(batch.column("src"))
            if pc.any(counted).as_py():
                total, one = _flat(batch.filter(counted).column("found"), np.int64)[0].sum(keepdims=True), np.ones(1, np.int64)
                lists = _lists(np.zeros(1), total, np.zeros(1), one) | {"src": pa.array([None], pa.int64())}
                yield pa.RecordBatch.from_pydict(lists | {"fresh": vectors.as_list_array(np.zeros(1, bool), one)})
                batch = batch.filter(pc.invert(counted))
            (old, before), (found, more) = (_flat(batch.column(c), np.int64) for c in ("dst", "found"))
            d2 = np.concatenate((_flat(batch.column("d2"), np.float64)[0], _flat(batch.column("found_d2"), np.float64)[0]))
            each = np.arange(batch.num_rows)
            row, dst = np.concatenate((np.repeat(each, before), np.repeat(each, more))), np.concatenate((old, found))
            fresh = np.arange(len(dst)) >= (0 if start else len(old))
            order = np.lexsort((fresh, dst, row))
            row, dst, d2, fresh = row[order], dst[order], d2[order], fresh[order]
            first = np.concatenate(([True], (row[1:] != row[:-1]) | (dst[1:] != dst[:-1])))[: len(row)]
            row, dst, d2, fresh = row[first], dst[first], d2[first], fresh[first]
            order = np.lexsort((dst, d2, row))
            kept = order[_places(row[order]) < size]
            sizes = np.bincount(row[kept], minlength=batch.num_rows)
            lists = _lists(batch.column("src").to_numpy(), dst[kept], d2[kept], sizes)
            yield pa.RecordBatch.from_pydict(lists | {"fresh": vectors.as_list_array(fresh[kept], sizes)})

    return run


def _deal(regions: int, size: int):
    """Send the members of each list to the tiles of their regions, and the end of each list to the tiles of its row.

    Many lists share a row: ``first`` and ``second`` hold the members in the two regions of the tile, with bits flipped if
    fresh, and ``sizes`` the two numbers of members of each list. On the diagonal ``first`` holds all of them. The other
    rows have the places of a ``region`` in ``first``, and what enters their lists must be nearer than ``ends``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (dst, ahead), (back, behind) = (_flat(batch.column(c), np.int64) for c in ("dst", "back"))
            fresh = np.concatenate((_flat(batch.column("fresh"), bool)[0], _flat(batch.column("back_fresh"), bool)[0]))
            row, member = np.concatenate((np.repeat(np.arange(n), ahead), np.repeat(np.arange(n), behind))), np.concatenate((dst, back))
            order = np.lexsort((~fresh, member, row))
            row, member, fresh = row[order], member[order], fresh[order]
            once = np.concatenate(([True], (row[1:] != row[:-1]) | (member[1:] != member[:-1])))[: len(row)]
            row, member, fresh = row[once], member[once], fresh[once]
            region, place = member >> PLACE_BITS, (member & ((1 << PLACE_BITS) - 1)).astype(np.int32)
            coded = np.where(fresh, ~place, place)
            cell = row * regions + region
            held = np.bincount(cell, minlength=n * regions).reshape(n, regions)
            news = np.bincount(cell[fresh], minlength=n * regions).reshape(n, regions)
            starts = (np.cumsum(held) - held.ravel()).reshape(n, regions)
            out = []
            for a in range(regions):
                for b in range(a, regions):
                    if a == b:
                        rows = np.flatnonzero((held[:, a] > 1) & (news[:, a] > 0))
                    else:
                        rows = np.flatnonzero((held[:, a] > 0) & (held[:, b] > 0) & (news[:, a] + news[:, b] > 0))
                    if len(rows):
                        first, second = (coded[_ranges(starts[rows, c], held[rows, c])] for c in (a, b))
                        sizes = np.stack((held[rows, a], held[rows, b]), axis=1).ravel()
                        out.append((a * regions + b, None, first, second if a != b else [], sizes, []))
            ends = np.full(n, np.inf)
            d2, full = _flat(batch.column("d2"), np.float64)[0], ahead >= size
            ends[full] = d2[(np.cumsum(ahead) - ahead)[full] + size - 1]
            home, place = np.divmod(batch.column("src").to_numpy(), 1 << PLACE_BITS)
            for a in np.unique(home).tolist():
                own = home == a
                out += [(min(a, b) * regions + max(a, b), a, place[own], [], [], ends[own]) for b in range(regions)]
            kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64())]
            columns = [pa.array([line[i] for line in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "region", "first", "second", "sizes", "ends"])

    return run


def _join_tile(k: int, regions: int):
    """Compare the members of lists that lie in the two regions of a tile; entries nearer than the ends of the lists they would enter.

    The row without source carries the number of comparisons.
    """

    def run(sent: pa.Table, members: pa.Table) -> pa.Table:
        none, no = np.empty(0, np.int64), np.empty(0)
        dealt = sent.filter(pc.is_null(sent["region"])) if sent.num_rows else sent
        if dealt.num_rows == 0 or members.num_rows == 0:
            return pa.table(_lists(none, none, no, none))
        left, right = divmod(int(members["tile"][0].as_py()), regions)
        members = members.sort_by([("region", "ascending"), ("place", "ascending")]).combine_chunks()
        region = members["region"].to_numpy().astype(np.int64)
        keys = (region << PLACE_BITS) + members["place"].to_numpy()
        begin = {left: 0, right: int(np.searchsorted(region, right))}
        points = vectors.flat_values(members["v"].combine_chunks())[0].reshape(len(keys), -1)
        norms = np.concatenate([(points[i : i + 65536].astype(np.float64) ** 2).sum(axis=1) for i in range(0, len(points), 65536)])
        room = vectors.SLACK * (1.0 + 2.0 * norms.max(initial=0.0))
        limit = np.full(len(keys), np.inf)
        known = sent.filter(pc.is_valid(sent["region"]))
        for home, place, ends in zip(known["region"].to_pylist(), known["first"], known["ends"], strict=True):
            limit[begin[home] + place.values.to_numpy()] = ends.values.to_numpy()
        sizes = _flat(dealt["sizes"].combine_chunks(), np.int64)[0].reshape(-1, 2)
        codes = [_flat(dealt[c].combine_chunks(), np.int32)[0] for c in ("first", "second")]
        alone = left == right
        if alone:
            codes[1] = codes[0]
        starts = np.cumsum(sizes, axis=0) - sizes
        order = np.lexsort((-sizes[:, 1], -sizes[:, 0]))
        widest, wide = int(sizes[:, 1].max()), points.shape[1]
        best, waiting, pairs, compared, at = (none, none, no), 0, [], 0, 0
        while at < len(order):
            longest = int(sizes[order[at], 0])
            lists = order[at : at + max(1, CELLS // (longest * widest + (longest + widest) * wide))]
            at += len(lists)
            index, new, inside = [], [], []
            for side, home in enumerate((left, right)):
                slots = np.arange(sizes[lists, side].max())[None, :]
                inside.append(slots < sizes[lists, side][:, None])
                code = codes[side][np.minimum(starts[lists, side][:, None] + slots, len(codes[side]) - 1)].astype(np.int64)
                new.append((code < 0) & inside[side])
                index.append(np.where(code < 0, ~code, code) + begin[home])
            (i, j), (a, b) = index, new
            met = inside[0][:, :, None] & inside[1][:, None, :] & (a[:, :, None] | b[:, None, :])
            if alone:
                met &= np.triu(np.ones(met.shape[1:], dtype=bool), 1)
            compared += int(met.sum())
            d2 = norms[i][:, :, None] + norms[j][:, None, :] - 2.0 * (points[i].astype(np.float64) @ points[j].astype(np.float64).transpose(0, 2, 1))
            row, a, b = np.nonzero(met & (d2 <= np.maximum(limit[i][:, :, None], limit[j][:, None, :]) + room))
            a, b = i[row, a], j[row, b]
            pairs.append(np.unique(np.minimum(a, b) * len(keys) + np.maximum(a, b)))
            waiting += len(pairs[-1])
            if waiting > PAIRS or at >= len(order):
                best = _ranked(best, np.unique(np.concatenate(pairs)), points, limit, k)
                waiting, pairs = 0, []
        a, b, d2 = best
        found, held = np.unique(a, return_counts=True)
        out = _lists(np.append(keys[found], 0), np.append(keys[b], compared), np.append(d2, 0.0), np.append(held, 1))
        out["src"] = pa.array(np.append(keys[found], 0), mask=np.append(np.zeros(len(found), bool), True))
        return pa.table(out)

    return run


def _ranked(best: tuple[np.ndarray, ...], pair: np.ndarray, points: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(row, other, d2)``: the ``k`` nearest of each row among those found so far and new pairs, exactly measured."""
    a, b = pair // len(points), pair % len(points)
    exact = np.empty(len(pair))
    for first in range(0, len(pair), CELLS // 64):
        part = slice(first, first + CELLS // 64)
        exact[part] = ((points[a[part]].astype(np.float64) - points[b[part]]) ** 2).sum(axis=1)
    a, b, exact = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((exact, exact))
    kept = (exact < limit[a]) & (a != b)
    a, b, exact = (np.concatenate((old, new[kept])) for old, new in zip(best, (a, b, exact), strict=True))
    order = np.lexsort((b, exact, a))
    a, b, exact = a[order], b[order], exact[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    a, b, exact = a[first], b[first], exact[first]
    kept = _places(a) < k
    return a[kept], b[kept], exact[kept]


@dataclass(frozen=True)
class Refined:
    """A refined graph, and what it took: rounds, and comparisons per row (those of the start included)."""

    graph: DataFrame
    rounds: int
    comparisons: float


def refine(
    df: DataFrame,
    k: int | None = None,
    id_col: str = "uuid",
    vec_col: str = "emb",
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
    normalize: bool = True,
    rounds: int = ROUNDS,
    spare: float = SPARE,
) -> Refined:
    """Refine lists of ``k + spare * k`` neighbours from those inside blocks, and keep ``k``: ``(src, dst, rank, dist)``.

    Rows are told apart by a key of their own, so ids may repeat or be null. A row named by many others meets at most
    as many of them as its own list holds, the new ones first; that bounds the work of a round, and what it costs in
    recall is part of the method. Hubs are cut before they are shuffled.
    """
    keyed = with_row_key(df.select(quoted(id_col).alias("id"), prepared(vec_col, normalize).alias("v")), "key")
    n = keyed.count()
    k = neighbours.umap_neighbours(n) if k is None else min(k, n - 1)
    if k < 1:
        ids = keyed.select("id")
        none = ids.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("rank"), F.lit(0.0).alias("dist"))
        return Refined(none, 0, 0.0)
    size = min(n - 1, k + int(spare * k))
    centers = neighbours._coarse_cells(keyed, n, block_rows, seed)
    hit = vectors.nearest_center(F.col("v"), list(range(len(centers))), centers)
    placed = cut_lineage(keyed.select("key", "id", "v", hit["cluster"].alias("cell")))
    # At most MAX_CELLS rows; a cell with many rows is dealt to several blocks, and to several regions.
    rows_of = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    most = min(max(1, REGION_BYTES // (4 * centers.shape[1])), max(LEAST_ROWS, -(-n // REGIONS)))
    regions_of, regions = neighbours._regions(centers, rows_of, most)
    starts, blocks = [], 0
    for cell, rows in sorted(rows_of.items()):
        shares = -(-rows // block_rows)
        starts.append((cell, blocks, shares, *regions_of[cell]))
        blocks += shares
    starts = keyed.sparkSession.createDataFrame(starts, "cell int, first int, shares int, region int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("shares"))).alias("block")
    region = (F.col("region") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))).cast("int").alias("region")
    points = placed.join(F.broadcast(starts), "cell").select(F.col("key").alias("row"), "id", "v", block, region)
    place = (F.row_number().over(Window.partitionBy("region").orderBy("row")) - 1).alias("place")
    points = points.select("*", place)
    points = cut_lineage(points.select("*", (F.shiftleft(F.col("region").cast("long"), PLACE_BITS) + F.col("place")).alias("key")))
    # Lists start inside the row's own block and inside a random one: without the latter no list would leave its block.
    mixed = points.select("key", "v", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).alias("block"))
    both = (points.select("key", "v", "block"), mixed)
    start = [part.repartition(blocks, "block").groupBy("block").applyInArrow(_first_lists(size), _LISTS) for part in both]
    # A list holds at most twice its wanted length, in the first round.
    graph = _merged(start[0].withColumn("fresh", F.lit(None).cast("array<boolean>")), start[1], 2 * size, True)
    met = F.sum(F.col("count") * (F.col("count") - 1))
    compared = sum(part.groupBy("block").count().agg(met).first()[0] for part in both) / 2.0

    tiles = regions * (regions + 1) // 2
    pairs = points.select("region", "place", "v", F.explode(F.sequence(F.lit(0), F.lit(regions - 1))).alias("other"))
    tile = (F.least("region", "other") * regions + F.greatest("region", "other")).alias("tile")
    tiled = pairs.select(tile, "region", "place", "v").repartition(tiles, "tile")
    done = 0
    for turn in range(rounds):
        sent = _dealt_lists(graph, size, turn, regions).repartition(tiles, "tile").groupBy("tile")
        found = sent.cogroup(tiled.groupBy("tile")).applyInArrow(_join_tile(size, regions), _LISTS)
        merged = _merged(graph, found, size, False)
        fresh, counted = F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.when(F.col("src").isNull(), F.get("dst", F.lit(0))))
        fresh, counted = merged.agg(fresh, counted).first()
        graph = merged.filter(F.col("src").isNotNull())
        compared += counted or 0
        done = turn + 1
        if (fresh or 0) <= TOLERANCE * n * size:
            break

    # Entries as near as the last of the k are told apart by the rows' own keys.
    near = F.filter(F.arrays_zip("dst", "d2"), lambda e: e["d2"] <= F.coalesce(F.get("d2", F.lit(k - 1)), F.lit(float("inf"))))
    edges = graph.select("src", F.explode(near).alias("e")).select("src", "e.dst", "e.d2")
    named = edges.join(points.select(F.col("key").alias("dst"), "row", F.col("id").alias("dst_id")), "dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "row"))
    named = named.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = named.join(points.select(F.col("key").alias("src"), F.col("id").alias("src_id")), "src")
    out = named.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "rank", F.sqrt("d2").alias("dist"))
    return Refined(out, done, compared / n)


def _merged(graph: DataFrame, found: DataFrame, size: int, start: bool) -> DataFrame:
    """The lists after a round; what several tiles found for a row comes together first."""
    found = found.groupBy("src").agg(F.collect_list(F.struct("dst", "d2")).alias("f"))
    found = found.select("src", F.flatten("f.dst").alias("found"), F.flatten("f.d2").alias("found_d2"))
    return cut_lineage(graph.join(found, "src", "full").mapInArrow(_merge(size, start), _STATE))


def _dealt_lists(graph: DataFrame, size: int, turn: int, regions: int) -> DataFrame:
    """Lists of one round, each with the rows that name its row, dealt to tiles."""
    entries = graph.select("src", F.explode(F.arrays_zip("dst", "fresh")).alias("e")).select("src", "e.dst", "e.fresh")
    # The limit also runs before the shuffle, so a row named by many does not meet them all in one task.
    named = Window.partitionBy("dst").orderBy(F.desc("fresh"), F.xxhash64("src", F.lit(turn)), "src")
    back = entries.withColumn("place", F.row_number().over(named)).filter(F.col("place") <= size)
    back = back.groupBy(F.col("dst").alias("src")).agg(F.collect_list(F.struct("src", "fresh")).alias("b"))
    back = back.select("src", F.col("b.src").alias("back"), F.col("b.fresh").alias("back_fresh"))
    return graph.join(back, "src", "full").mapInArrow(_deal(regions, size), _DEALT)


def knn_descent(df: DataFrame, k: int | None = None, id_col: str = "uuid", vec_col: str = "emb", **options) -> DataFrame:
    """``(src, dst, rank, dist)`` like :func:`neighbours.knn_graph`, approximate and without comparing all pairs."""
    return refine(df, k, id_col, vec_col, **options).graph
