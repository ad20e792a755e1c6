"""Exact nearest-neighbour graph, and the neighbour weights of the UMAP and t-SNE papers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators.projection import prepared
from vectorlens.session import cut_lineage

# Rows of one block, in which a query finds its first reach.
BLOCK_ROWS = 4096
# Queries and points that meet in one task, as bytes of double vectors. Both travel once to each task that needs them, so
# what is shuffled falls with the size of a task. Up to TASKS tasks are made of smaller tables.
QUERY_BYTES, POINT_BYTES = 16 * 1024 * 1024, 64 * 1024 * 1024
TASKS = 24
# Points compared at once inside a task. Cells of fewer than FEW points are met several at once.
SLICE, FEW = 4096, 1024
# A query with more hits in a slice than so many times k is ranked at once.
CROWD = 4
# Squared lengths between which products are taken in single precision.
SINGLE = (1e-18, 1e18)
# Upper bounds of the coarse cells and of the separately treated heavy groups; both are broadcast.
MAX_CELLS = 2048
MAX_CELL_BYTES = 64 * 1024 * 1024
MAX_HEAVY = 1000
# Groups of copies below this size are never salted.
HEAVY_ROWS = 10_000
# Most partitions of the comparison stages. Their number is given, because a block is small but costly and
# adaptive execution would merge blocks by size.
MAX_PARTITIONS = 16_384


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


def umap_neighbours(n: int) -> int:
    return min(15, max(2, n - 1))


def tsne_perplexity(n: int) -> int:
    return min(30, max(5, n // 3))


def _coarse_cells(points: DataFrame, n: int, block_rows: int, seed: int) -> np.ndarray:
    """Cell centers from a sample. They steer how much is compared, never what is found."""
    first = points.select("v").head(1)
    if not first:
        return np.zeros((1, 1))
    width = len(first[0][0])
    wanted = min(MAX_CELLS, MAX_CELL_BYTES // (8 * width), n // block_rows)
    if wanted < 2:
        return np.zeros((1, width))
    sample = points.select(array_to_vector("v").alias("features"))
    if n > 200 * wanted:
        sample = sample.sample(200 * wanted / n, seed)
    model = KMeans(k=wanted, seed=seed, maxIter=5, tol=1e-3, initMode="random").fit(sample)
    return np.array(model.clusterCenters())


def _regions(centers: np.ndarray, rows_of: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First region and number of regions of every cell, and how many regions there are; none is meant to pass ``most`` rows.

    Cells that lie side by side along the widest axis share a region, a cell with more rows is dealt to several.
    """
    apart = np.nan_to_num(centers - centers.mean(axis=0))
    along = apart @ np.linalg.svd(apart, full_matrices=False)[2][0]
    found, regions, held = {}, 0, most
    for cell in sorted(rows_of, key=lambda c: (along[c], c)):
        parts = max(1, math.ceil(rows_of[cell] / most))
        if parts > 1 or held + rows_of[cell] > most:
            found[cell] = (regions, parts)
            regions += parts
            held = most if parts > 1 else rows_of[cell]
        else:
            found[cell] = (regions - 1, 1)
            held += rows_of[cell]
    return found, regions


def _room(points: np.ndarray, centers: np.ndarray) -> float:
    """Room for rounding, which grows with the length of the vectors."""
    return 1e-6 * (1.0 + math.sqrt(max((points * points).sum(axis=1).max(initial=0.0), (centers * centers).sum(axis=1).max(initial=0.0))))


def _first_reach(centers: np.ndarray, radii: np.ndarray, regions_of: dict[int, tuple[int, int]], regions: int, k: int):
    """Within one block: how far its queries need to look, and the regions that may hold closer points."""
    member = np.zeros((len(centers), regions), dtype=np.float32)
    for cell, (first, parts) in regions_of.items():
        member[cell, first : first + parts] = 1.0

    def search(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        points = vectors.as_matrix(block["v"].combine_chunks())
        is_query = block["is_query"].to_numpy(zero_copy_only=False)
        queries = points[is_query]
        where, dist = vectors.closest(queries, points, k)
        limit = np.sqrt(dist[:, -1]) if where.shape[1] == k else np.full(len(queries), np.inf)
        hits = []
        room = _room(points, centers)
        for start in range(0, len(queries), vectors.CHUNK):
            part = slice(start, start + vectors.CHUNK)
            lower = np.sqrt(vectors.squared_distances(queries[part], centers)) - radii[None, :]
            row, region = np.nonzero((lower <= limit[part, None] + room).astype(np.float32) @ member)
            hits.append((row + start, region))
        rows, found = (np.concatenate(side) for side in zip(*hits)) if hits else (np.empty(0, int), np.empty(0, int))
        chosen = pa.array(np.flatnonzero(is_query))
        columns = [
            *[block[name].combine_chunks().take(chosen) for name in ("id", "v", "cell")],
            pa.array(limit),
            vectors.as_list_array(found.astype(np.int32), np.bincount(rows, minlength=len(queries))),
        ]
        return pa.table(columns, names=["id", "v", "home", "reach", "regions"])

    return search


class _Rough:
    """Queries and points of a task around a common center, in single precision where their size allows it.

    ``room`` bounds what the products lose to rounding, so that a comparison with them drops no point within reach.
    """

    def __init__(self, queries: np.ndarray, points: np.ndarray):
        center = points.mean(axis=0)
        center = center if np.isfinite(center).all() else np.zeros(len(center))
        queries, points = queries - center, points - center
        self.norms, halves = (queries * queries).sum(axis=1), (points * points).sum(axis=1) / 2.0
        longest = self.norms.max(initial=0.0) + 2.0 * halves.max(initial=0.0)
        single = bool(SINGLE[0] < longest < SINGLE[1])
        kind = np.float32 if single else np.float64
        lost = 2.0 * (points.shape[1] + 8) * np.finfo(np.float32).eps if single else vectors.SLACK
        self.room = lost * (SINGLE[0] + longest)
        self.queries = np.concatenate((queries, np.ones((len(queries), 1))), axis=1).astype(kind)
        self.points = np.concatenate((points, -halves[:, None]), axis=1).astype(kind)


def _set_places(near: np.ndarray) -> np.ndarray:
    """Positions of the true cells of a matrix, in row-major order; few are true, so eight are passed over at once."""
    flat = near.ravel()
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    inner = (eight[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate((inner[flat[inner]], np.flatnonzero(flat[whole:]) + whole))


def _within_reach(queries: np.ndarray, reach: np.ndarray, points: np.ndarray, k: int, rough: tuple[np.ndarray, np.ndarray, np.ndarray, float]):
    """Row and position of the points within each query's reach, with squared distances; all of the k nearest are among them.

    ``rough`` has the queries, their squared norms, the points and the room of :class:`_Rough`. A query that has found close
    neighbours already meets few points in reach; those are picked by one comparison with the product matrix and measured in
    double precision. Only queries with very many hits need a ranking here.
    """
    near_queries, norms, near_points, room = rough
    limit = (norms - reach * reach) / 2.0 - room
    product = near_queries @ near_points.T
    hit = _set_places(product >= limit.astype(product.dtype)[:, None])
    row, col = np.divmod(hit, len(points))
    rows, cols, dist = [], [], []
    crowded = np.bincount(row, minlength=len(queries)) > CROWD * k
    if crowded.any():
        found, value = vectors.closest(queries[crowded], points, k)
        rows.append(np.repeat(np.flatnonzero(crowded), found.shape[1]))
        cols.append(found.ravel())
        dist.append(value.ravel())
        row, col = row[~crowded[row]], col[~crowded[row]]
    rows.append(row)
    cols.append(col)
    dist.append(((points[col] - queries[row]) ** 2).sum(axis=1))
    row, col, d2 = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    kept = np.sqrt(d2) <= reach[row] * (1.0 + vectors.SLACK) + vectors.SLACK
    return row[kept], col[kept], d2[kept]


class _Nearest:
    """The k nearest points that each query of a chunk has met so far, ties to the earlier position."""

    def __init__(self, queries: int, k: int):
        self.dist = np.full((queries, k), np.inf)
        self.where = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, where: np.ndarray, dist: np.ndarray) -> None:
        k = self.dist.shape[1]
        grown = np.unique(row)
        row = np.concatenate((np.repeat(grown, k), row))
        where = np.concatenate((self.where[grown].ravel(), where))
        dist = np.concatenate((self.dist[grown].ravel(), dist))
        order = np.lexsort((where, dist, row))
        row, where, dist = row[order], where[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        self.where[row[kept], rank[kept]] = where[kept]
        self.dist[row[kept], rank[kept]] = dist[kept]


def _search_region(centers: np.ndarray, radii: np.ndarray, k: int):
    """Queries against the points of one region: the k nearest points within each query's reach.

    Cells are met from the nearest on. The reach of a query shrinks with what it finds, and cells beyond it are left out.
    """

    def search(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = pa.schema([("src", queries.schema.field("id").type), ("dst", points.schema.field("id").type), ("d2", pa.float64())])
        if queries.num_rows == 0 or points.num_rows == 0:
            return out.empty_table()
        points = points.take(pc.sort_indices(points["id"], null_placement="at_start")).combine_chunks()
        queries = queries.sort_by("home").combine_chunks()
        matrix, asked = (vectors.as_matrix(side["v"].combine_chunks()) for side in (points, queries))
        reach = queries["reach"].to_numpy().copy()
        cell = points["cell"].to_numpy()
        # Points of a cell stand together, in id order; a cell is then met without copying its points for every chunk.
        by_cell = np.argsort(cell, kind="stable")
        matrix = matrix[by_cell]
        present, starts = np.unique(cell[by_cell], return_index=True)
        ends = np.append(starts[1:], len(cell))
        room = max(_room(matrix, centers), _room(asked, centers))
        rough = _Rough(asked, matrix)
        found = []
        for start in range(0, len(asked), vectors.CHUNK):
            chunk = slice(start, start + vectors.CHUNK)
            part, limit = asked[chunk], reach[chunk]
            lower = np.sqrt(vectors.squared_distances(part, centers[present])) - radii[present][None, :]
            nearest = _Nearest(len(part), k)
            order = np.argsort(lower.min(axis=0), kind="stable")
            waiting, held, hits = [], 0, []

            def settle(hits=hits, nearest=nearest, limit=limit):
                if hits:
                    nearest.add(*(np.concatenate(side) for side in zip(*hits)))
                    np.minimum(limit, np.sqrt(nearest.dist[:, -1]), out=limit)
                    hits.clear()

            def meet(waiting=waiting, part=part, limit=limit, chunk=chunk, hits=hits, settle=settle):
                if len(waiting) == 1:
                    slices = [slice(first, min(first + SLICE, waiting[0][1])) for first in range(*waiting[0], SLICE)]
                else:
                    here = np.concatenate([np.arange(*span) for span in waiting])
                    here = here[np.argsort(by_cell[here])]
                    slices = [here[first : first + SLICE] for first in range(0, len(here), SLICE)]
                for some in slices:
                    sides = (rough.queries[chunk], rough.norms[chunk], rough.points[some], rough.room)
                    row, col, d2 = _within_reach(part, limit, matrix[some], k, sides)
                    if len(row):
                        hits.append((row, by_cell[some][col], d2))
                    # Ranking what was found costs more than a few hits too many.
                    if sum(len(h[0]) for h in hits) >= len(part) * k / 2:
                        settle()
                waiting.clear()

            for at in order:
                if (lower[:, at] <= limit + room).any():
                    size = ends[at] - starts[at]
                    if waiting and size >= FEW:
                        meet()
                        held = 0
                    waiting.append((starts[at], ends[at]))
                    held += size
                    if size >= FEW or held >= SLICE:
                        meet()
                        held = 0
            if waiting:
                meet()
            settle()
            row, rank = np.nonzero(np.isfinite(nearest.dist))
            found.append((row + start, nearest.where[row, rank], nearest.dist[row, rank]))
        row, where, d2 = (np.concatenate(side) for side in zip(*found))
        return pa.table(
            [queries["id"].combine_chunks().take(pa.array(row)), points["id"].combine_chunks().take(pa.array(where)), pa.array(d2)],
            schema=out,
        )

    return search


def knn_graph(
    df: DataFrame,
    k: int | None = None,
    id_col: str = "uuid",
    vec_col: str = "emb",
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
    normalize: bool = True,
) -> DataFrame:
    """``(src, dst, rank, dist)``: the k nearest other rows of each row on prepared vectors, ties by id.

    Without ``normalize`` the vectors are compared as they are.

    Exact. Rows are grouped into coarse cells, cells split into blocks of bounded size. A first pass inside
    each block gives every query a reach; by the triangle inequality only cells within that reach are then
    compared. Cells are put together to regions, and a task compares a part of the queries with one region: both
    are of bounded size, but as large as a task can hold, for a row travels once to every region or part that it
    meets. Identical vectors are searched once: of a group of copies only the k + 1 lowest ids can be anyone's
    neighbour, and all copies share one result.
    """
    points = df.select(quoted(id_col).alias("id"), prepared(vec_col, normalize).alias("v"))
    # Two differently seeded hashes, 128 bits, stand for the vector when copies are looked for. The constant
    # comes first: Spark seeds each argument's hash with the one before.
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    points = cut_lineage(points.select("id", "v", *hashes))
    n = points.count()
    k = umap_neighbours(n) if k is None else min(k, n - 1)
    spark = df.sparkSession
    id_field = points.schema["id"].dataType
    if k < 1:
        return spark.createDataFrame([], _schema(src=id_field, dst=id_field, rank=T.IntegerType(), dist=T.DoubleType()))

    # The rank limit runs before the shuffle as well, so a huge group of copies never meets in one task.
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    ranked = points.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    centers = _coarse_cells(points, n, block_rows, seed)
    hit = vectors.nearest_center(F.col("v"), list(range(len(centers))), centers)
    placed = ranked.withColumn("hit", hit)
    placed = cut_lineage(
        placed.select("id", "v", "h1", "h2", "copy", F.col("hit.cluster").alias("cell"), F.sqrt("hit.dist2").alias("radius"))
    )
    # At most MAX_CELLS rows.
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("radius").alias("radius"), F.count_if(F.col("copy") > 1).alias("extra")
    ).collect()
    radii = np.full(len(centers), -np.inf)
    for cell in sizes:
        radii[cell["cell"]] = cell["radius"]
    blocks_of = {cell["cell"]: math.ceil(cell["rows"] / block_rows) for cell in sizes}
    cell_blocks = F.broadcast(spark.createDataFrame(list(blocks_of.items()), "cell int, blocks int"))
    in_blocks = placed.join(cell_blocks, "cell").withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )

    most = max(1, POINT_BYTES // (8 * max(1, centers.shape[1])))
    regions_of, regions = _regions(centers, {cell["cell"]: cell["rows"] for cell in sizes}, most)
    queries = in_blocks.select("id", "v", "cell", "blk", (F.col("copy") == 1).alias("is_query"))
    n_blocks = sum(blocks_of.values())
    if n_blocks > 1:
        schema = _schema(
            id=id_field, v=vectors.VECTOR, home=T.IntegerType(), reach=T.DoubleType(), regions=T.ArrayType(T.IntegerType())
        )
        blocks = queries.repartition(min(n_blocks, MAX_PARTITIONS), "cell", "blk").groupBy("cell", "blk")
        asked = cut_lineage(blocks.applyInArrow(_first_reach(centers, radii, regions_of, regions, k + 1), schema))
    else:
        everywhere = F.sequence(F.lit(0), F.lit(regions - 1))
        asked = queries.filter("is_query").select(
            # Columns of their own: both sides of the comparison come from the same rows.
            *[F.col(c).alias(c) for c in ("id", "v")],
            F.col("cell").alias("home"),
            F.lit(float("inf")).alias("reach"),
            everywhere.alias("regions"),
        )
    found = _search_regions(asked, placed, regions_of, block_rows, k + 1, centers, radii)

    by_distance = Window.partitionBy("src").orderBy("d2", "dst")
    lists = found.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k + 1)
    has_copies = any(cell["extra"] for cell in sizes)
    if has_copies:
        lists = cut_lineage(lists)
    # A query is the lowest id among its copies and so the first entry of its own list.
    edges = lists.filter(F.col("rank") > 1).select(
        "src", "dst", (F.col("rank") - 1).cast("int").alias("rank"), F.sqrt("d2").alias("dist")
    )
    if has_copies:
        edges = edges.unionByName(_edges_of_copies(lists, points, placed, n, k))
    return edges


def _search_regions(
    asked: DataFrame,
    placed: DataFrame,
    regions_of: dict[int, tuple[int, int]],
    block_rows: int,
    k: int,
    centers: np.ndarray,
    radii: np.ndarray,
) -> DataFrame:
    """``(src, dst, d2)``: the k nearest points of each query in every region that it visits."""
    spark = asked.sparkSession
    id_field = asked.schema["id"].dataType
    visits = asked.select("id", "v", "home", "reach", F.explode("regions").alias("region"))
    visited = {r["region"]: r["count"] for r in asked.select(F.explode("regions").alias("region")).groupBy("region").count().collect()}
    # Parts of the queries of a region: as many as the tasks of a small table, or as memory asks for.
    most = max(1, QUERY_BYTES // (8 * max(1, centers.shape[1])))
    plan = [
        (region, max(math.ceil(rows / most), min(math.ceil(rows / block_rows), math.ceil(TASKS / len(visited)))))
        for region, rows in visited.items()
    ]
    parts = F.broadcast(spark.createDataFrame(plan, "region int, parts int"))
    requests = (
        visits.join(parts, "region")
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
        .select("id", "v", "home", "reach", "region", "part")
    )
    # At most MAX_CELLS rows.
    dealt = F.broadcast(spark.createDataFrame([(c, *r) for c, r in regions_of.items()], "cell int, first int, shares int"))
    offered = (
        placed.join(dealt, "cell")
        .withColumn("region", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(4)), F.col("shares"))).cast("int"))
        .join(parts, "region")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "v", "cell", "region", "part")
    )
    tasks = min(sum(n for _, n in plan), MAX_PARTITIONS)
    left, right = (side.repartition(tasks, "region", "part").groupBy("region", "part") for side in (requests, offered))
    schema = _schema(src=id_field, dst=id_field, d2=T.DoubleType())
    return left.cogroup(right).applyInArrow(_search_region(centers, radii, k), schema)


def _edges_of_copies(lists: DataFrame, points: DataFrame, placed: DataFrame, n: int, k: int) -> DataFrame:
    """Edges of rows that repeat an earlier vector: the list of the first copy, without the row itself.

    Groups above n / 1000 rows (there can be no more than 1000) are salted; the others are joined as they are.
    """
    spark = points.sparkSession
    heavy_from = max(HEAVY_ROWS, n // MAX_HEAVY)
    groups = points.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"))
    heavy = F.broadcast(
        groups.filter(F.col("rows") > heavy_from).select(
            "h1", "h2", F.ceil(F.col("rows") / F.lit(heavy_from)).cast("int").alias("salts")
        )
    )
    firsts = placed.select("id", "h1", "h2", "copy")
    members = (
        points.select("id", "h1", "h2")
        .join(firsts.select("id", "copy"), "id", "left")
        .withColumn("copy", F.coalesce("copy", F.lit(k + 2)))
        .filter(F.col("copy") > 1)
        .join(heavy, ["h1", "h2"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("salts", F.lit(1))).cast("int"))
    )
    shared = (
        lists.join(firsts.filter(F.col("copy") == 1).select(F.col("id").alias("src"), "h1", "h2"), "src")
        .join(heavy, ["h1", "h2"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .select("h1", "h2", "salt", "dst", "rank", "d2")
    )
    joined = members.drop("salts").join(shared, ["h1", "h2", "salt"])
    # Copies stand in id order at the head of the list, so a row's own place in it is its copy number.
    rank = F.col("rank") - (F.col("rank") > F.col("copy")).cast("int")
    kept = joined.filter((F.col("rank") != F.col("copy")) & (rank <= k))
    return kept.select(F.col("id").alias("src"), "dst", rank.cast("int").alias("rank"), F.sqrt("d2").alias("dist"))


def adjacency(graph: DataFrame) -> DataFrame:
    """``(src, dst[], dist[])`` in rank order; a row has at most k neighbours."""
    entry = F.struct("rank", "dst", "dist")
    rows = graph.groupBy("src").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select("src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"))


def _bisect(level, target: np.ndarray | float, rows: int) -> np.ndarray:
    """Per row, the positive scale at which a rising function of the scale meets the target.

    ``level`` takes scales and the rows that they belong to; rows whose scale no longer changes are left out.
    """
    low, high, scale = np.zeros(rows), np.full(rows, np.inf), np.ones(rows)
    active = np.arange(rows)
    for _ in range(100):
        now = scale[active]
        above = level(now, active) > target
        high[active] = np.where(above, now, high[active])
        low[active] = np.where(above, low[active], now)
        upper = high[active]
        scale[active] = np.where(np.isinf(upper), np.minimum(now * 2.0, 1e30), (low[active] + upper) / 2.0)
        active = active[scale[active] != now]
        if not len(active):
            break
    return scale


def _per_length(distances: pa.Array, weigh) -> pa.Array:
    """Apply a matrix function to the rows of each list length."""
    lengths = distances.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = distances.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = np.empty_like(flat)
    for length in np.unique(lengths[lengths > 0]):
        of_length = starts[lengths == length]
        for first in range(0, len(of_length), vectors.CHUNK):
            at = of_length[first : first + vectors.CHUNK, None] + np.arange(length)[None, :]
            out[at] = weigh(flat[at])
    return vectors.as_list_array(out, lengths)


def fuzzy_membership(distances: Column) -> Column:
    """Membership strengths ``exp(-max(0, d - rho) / sigma)`` that sum to ``log2(k)`` per row.

    ``rho`` is the smallest positive distance of the row. Rows whose neighbours all lie within ``rho`` sum
    to k whatever the scale and keep strength 1.
    """

    def weigh(d: np.ndarray) -> np.ndarray:
        positive = np.where(d > 0, d, np.inf).min(axis=1)
        rho = np.where(np.isfinite(positive), positive, 0.0)
        gap = np.maximum(d - rho[:, None], 0.0)
        target = np.log2(d.shape[1]) if d.shape[1] > 1 else 1.0
        sigma = _bisect(lambda s, at: np.exp(-gap[at] / np.maximum(s, 1e-30)[:, None]).sum(axis=1), target, len(d))
        return np.exp(-gap / np.maximum(sigma, 1e-30)[:, None])

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def strengths(d: pa.Array) -> pa.Array:
        return _per_length(d, weigh)

    return strengths(distances)


def gaussian_affinity(distances: Column, perplexity: float) -> Column:
    """Conditional neighbour probabilities whose entropy matches ``log(perplexity)``; each row sums to 1."""

    def weigh(d: np.ndarray) -> np.ndarray:
        square = d * d - (d * d).min(axis=1, keepdims=True)
        goal = math.log(min(perplexity, d.shape[1]))

        def probabilities(scale: np.ndarray, at: np.ndarray) -> np.ndarray:
            p = np.exp(-square[at] / np.maximum(scale, 1e-30)[:, None])
            return p / p.sum(axis=1, keepdims=True)

        def entropy(scale: np.ndarray, at: np.ndarray) -> np.ndarray:
            p = probabilities(scale, at)
            return -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)

        return probabilities(_bisect(entropy, goal, len(d)), np.arange(len(d)))

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def affinities(d: pa.Array) -> pa.Array:
        return _per_length(d, weigh)

    return affinities(distances)


def _weighted_edges(graph: DataFrame, weight) -> DataFrame:
    rows = adjacency(graph).withColumn("w", weight(F.col("dist")))
    pairs = rows.select("src", F.explode(F.arrays_zip("dst", "w")).alias("e"))
    return pairs.select("src", F.col("e.dst").alias("dst"), F.col("e.w").alias("w"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each directed edge with its reverse; a pair then holds one or two weights."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """``(src, dst, w)``: memberships symmetrized as ``a + b - ab``, by one grouping instead of a self-join."""
    pairs = _both_ways(_weighted_edges(graph, fuzzy_membership))
    merged = pairs.groupBy("src", "dst").agg(
        F.sum("w").alias("total"), F.min("w").alias("low"), F.max("w").alias("high"), F.count(F.lit(1)).alias("ways")
    )
    both = F.col("ways") == 2
    return merged.select(
        "src", "dst", F.when(both, F.col("total") - F.col("low") * F.col("high")).otherwise(F.col("total")).alias("w")
    ).filter(F.col("w") > 0)


def perplexity_affinities(graph: DataFrame, n: int, perplexity: float | None = None) -> DataFrame:
    """``(src, dst, p)``: affinities ``(p_j|i + p_i|j) / 2n``, which sum to 1 over the graph."""
    wanted = tsne_perplexity(n) if perplexity is None else perplexity
    pairs = _both_ways(_weighted_edges(graph, lambda d: gaussian_affinity(d, wanted)))
    return pairs.groupBy("src", "dst").agg((F.sum("w") / F.lit(2.0 * n)).alias("p"))
