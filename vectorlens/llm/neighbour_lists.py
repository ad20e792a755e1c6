"""Approximate nearest neighbours by balanced posting lists.

Vectors with the largest inner products are the nearest ones after one coordinate is added that gives every stored
vector the same length. Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
centroid, and a vector near a boundary to further lists whose centroids are almost as near. Lists come out balanced
since a centroid with too many vectors of the sample is split at the cost of the smallest, and longer lists are dealt
into blocks.

A query walks a graph over the centroids, held in memory, from near to nearer ones, and takes the lists whose centroid
is at most a ratio farther than the nearest. The ratio grows with the table as needed: a bounded number of its queries is
answered by brute force, and the ratio is the least with which they find ``AIM`` of their neighbours. A walk that is
full before it reaches the ratio is replaced by the distances to all centroids. Lists are scored exactly, in double precision, on the original
vectors, in tasks of one block of a list and one block of its queries. A query's first lists are scored before the
others, and its k-th score so far goes with it to the rest: they return only what reaches it.

Lists grow with the square root of the table, so that a query asks for few of them and none of the steps is held by a
number of lists that grows with the rows.

Of identical vectors only the ``k + 1`` least ids can be among the nearest k of any query, so others are left out
before lists are made; a vector that a third of all rows share is one short run in its list.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept

# Bounds of the fit: bytes of the sample, and centroids held by every task.
SAMPLE_BYTES, MAX_CENTROIDS = 32 << 20, 16_384
ROWS_PER_LIST, ROUNDS = 256, 8
# Lists hold so many vectors in tables of up to this size, and more by the square root of the growth beyond it.
SMALL_TABLE = 16_384
# A vector goes to at most so many lists, with centroids at most this ratio farther (squared) than its nearest.
REPLICAS, BOUNDARY_RATIO = 2, 1.05
# A query reads lists whose centroids are at most this ratio farther (squared) than the nearest one, or the fitted one.
LIST_RATIO = 1.1
# Lists that are scored before the others, to bound what those return.
FIRST_LISTS = 4
# Queries answered by brute force to fit the ratio, and the share of their neighbours to find: a margin over 0.9.
TRIALS, AIM = 128, 0.94
LINKS, LONG_LINKS, BEAM = 24, 4, 256
BLOCK = 4096
# Distances that a task holds at once.
HELD_DISTANCES = 1 << 22


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)``: vectors as little-endian doubles. Null and zero vectors, and those with null or non-finite
    components, are left out, and so are vectors of another width than most and rows with a null id."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("e")
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(sizes))
            clean = np.where(np.isfinite(flat), flat, 0.0)
            some = np.bincount(row, weights=clean != 0, minlength=len(sizes))
            keep = (bad == 0) & (some > 0)
            ends = np.cumsum(sizes)
            raw = flat.astype("<f8") + 0.0  # no negative zeros
            data = [raw[e - s : e].tobytes() for s, e in zip(sizes[keep], ends[keep], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), pa.array(data, pa.binary())], ["vec_id", "v"])

    found = kept(rows.mapInArrow(run, "vec_id long, v binary").distinct(), "vectors")
    widths = found.groupBy(F.length("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    return found if widths is None else found.filter(F.length("v") == widths["w"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1) if values else np.empty((0, 0))


def lifted(points: np.ndarray, top: float) -> np.ndarray:
    """Points with the coordinate that brings each to the squared length ``top``."""
    rest = np.sqrt(np.maximum(top - (points * points).sum(axis=1), 0.0))
    return np.hstack((points, rest[:, None]))


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    cross = points @ centers.T
    return np.maximum((points * points).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * cross, 0.0)


def by_rows(points: np.ndarray, centers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of bounded blocks of points: ``(first row, distances)``."""
    step = max(1, HELD_DISTANCES // max(len(centers), 1))
    for start in range(0, len(points), step):
        yield start, distances(points[start : start + step], centers)


def list_count(n: int) -> int:
    per_list = ROWS_PER_LIST * max(1.0, (n / SMALL_TABLE) ** 0.5)
    return max(1, min(MAX_CENTROIDS, int(n / per_list)))


def fit_centroids(points: np.ndarray, lists: int) -> np.ndarray:
    """K-Means rounds in which the smallest cluster moves into the largest while that has over twice the mean."""
    random = np.random.RandomState(4)
    lists = min(lists, len(points))
    centers = points[random.choice(len(points), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([far.argmin(axis=1) for _, far in by_rows(points, centers)])
        sizes = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled, None]
        order = np.argsort(sizes, kind="stable")
        for small, large in zip(order, order[::-1], strict=True):
            if sizes[large] <= 2 * len(points) / lists or small == large:
                break
            members = points[nearest == large]
            centers[small] = members[random.randint(len(members))]
    return np.unique(centers, axis=0)


def centroid_graph(centers: np.ndarray) -> np.ndarray:
    """Neighbours of every centroid: the nearest ones, and a few at random so that no part is cut off."""
    random = np.random.RandomState(5)
    near = min(LINKS, len(centers) - 1)
    rows = [np.argsort(far, axis=1, kind="stable")[:, 1 : near + 1] for _, far in by_rows(centers, centers)]
    return np.hstack((np.vstack(rows), random.randint(len(centers), size=(len(centers), LONG_LINKS))))


def search_graph(query: np.ndarray, centers: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> list[tuple[float, int]]:
    """Best-first walk: up to ``beam`` centroids near the query, as ``(squared distance, centroid)``, nearest first.

    It ends when no unvisited neighbour is nearer than the worst centroid of a full beam.
    """
    entries = np.unique(np.linspace(0, len(centers) - 1, min(len(centers), 16)).astype(int))
    far = lambda at: ((centers[at] - query) ** 2).sum(axis=1)
    seen = np.zeros(len(centers), dtype=bool)
    seen[entries] = True
    todo = sorted(zip(far(entries).tolist(), entries.tolist(), strict=True))
    best = [(-d, c) for d, c in todo]
    best.sort()
    while todo:
        d, c = heappop(todo)
        if len(best) >= beam and d > -best[0][0]:
            break
        new = np.unique(graph[c])
        new = new[~seen[new]]
        seen[new] = True
        for e, o in zip(far(new).tolist(), new.tolist(), strict=True):
            if len(best) < beam or e < -best[0][0]:
                heappush(todo, (e, o))
                heappush(best, (-e, o))
                if len(best) > beam:
                    heappop(best)
    return sorted((-d, c) for d, c in best)


def near_lists(query: np.ndarray, centers: np.ndarray, graph: np.ndarray | None, ratio: float, enough: int, sizes: np.ndarray) -> list[int]:
    """Centroids at most ``ratio`` times (squared) as far from a query as the nearest one, and as many more as hold
    ``enough`` vectors."""

    def cut(far: np.ndarray) -> int:
        held = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        return int(np.count_nonzero((held < enough) | (far <= far[0] * ratio)))

    if graph is not None and len(centers) > BEAM:
        found = search_graph(query, centers, graph, BEAM)
        order = np.array([c for _, c in found])
        many = cut(np.array([d for d, _ in found]))
        if many < len(order):
            return order[:many].tolist()
    far = ((centers - query) ** 2).sum(axis=1)
    order = np.argsort(far, kind="stable")
    return order[: cut(far[order])].tolist()


def list_members(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, list)``: the lists of every lifted point."""
    rows, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for start, far in by_rows(points, centers):
        near = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
        value = np.take_along_axis(far, near, axis=1)
        row, col = np.nonzero(value <= value[:, :1] * BOUNDARY_RATIO)
        rows.append(row + start)
        found.append(near[row, col])
    return np.concatenate(rows), np.concatenate(found)


def fitted_ratio(stored: DataFrame, queries: DataFrame, centers: np.ndarray, top: float, k: int) -> float:
    """Least ratio with which ``TRIALS`` queries, the first in hash order, find ``AIM`` of their k neighbours.

    The neighbours come from one scan of all stored vectors; k of them for every trial reach the driver.
    """
    trials = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toArrow()
    names, asked = trials["vec_id"].to_numpy(), matrix(trials["v"])
    if len(names) == 0:
        return 1.0
    shared = stored.sparkSession.sparkContext.broadcast((names, asked))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("vec_id").to_numpy()
            scores = np.where(ids[None, :] == names[:, None], -np.inf, asked @ matrix(batch.column("v")).T)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            trial, col = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
            at = best[trial, col]
            yield pa.RecordBatch.from_arrays([pa.array(trial), batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(scores[trial, at])], ["trial", "vec_id", "v", "score"])

    met = stored.mapInArrow(brute, "trial long, vec_id long, v binary, score double")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id")
    wanted = met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("trial", "v").toArrow()
    if wanted.num_rows == 0:
        return 1.0
    far = distances(np.hstack((asked, np.zeros((len(asked), 1)))), centers)
    far = far / np.maximum(far.min(axis=1, keepdims=True), 1e-300)
    row, of = list_members(lifted(matrix(wanted["v"]), top), centers)
    reached = np.full(wanted.num_rows, np.inf)
    np.minimum.at(reached, row, far[wanted["trial"].to_numpy()[row], of])
    return float(np.quantile(reached, AIM, method="higher")) * (1 + 1e-9)


def nearest(df: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_ratio: float | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products found for every query, ties to smaller ids.

    Queries are the usable rows whose id is divisible by ``query_every``. They read lists up to ``list_ratio``; if
    it is not given, up to the larger of ``LIST_RATIO`` and the one fitted to the table. A repeated row counts once. An id with
    several vectors asks with the least of them in byte order, and is found by its best. Queries without any other
    usable vector, and tables without usable vectors, give no rows.
    """
    session = df.sparkSession
    empty = session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = kept(usable(df, id_col, vec_col), "usable")
    n = vectors.count()
    if n == 0:
        return empty
    width = vectors.agg(F.max(F.length("v"))).first()[0] // 8
    few = Window.partitionBy("v").orderBy("vec_id")
    stored = vectors.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).drop("r")
    stored = kept(stored, "stored")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([pa.array([(points * points).sum(axis=1).max(initial=0.0)])], ["top"])

    top = stored.mapInArrow(lengths, "top double").agg(F.max("top")).first()[0]
    rows = max(1024, SAMPLE_BYTES // (8 * (width + 1)))
    sample = stored.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(rows).toArrow()["v"]
    centers = fit_centroids(lifted(matrix(sample), top), list_count(stored.count()))
    shared = session.sparkContext.broadcast((centers, centroid_graph(centers) if len(centers) > 1 else None))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _ = shared.value
        for batch in batches:
            points = lifted(matrix(batch.column("v")), top)
            if len(points) == 0:
                continue
            row, of = list_members(points, centers)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "vec_id", "v"])

    lists = kept(stored.mapInArrow(assign, "list int, vec_id long, v binary"), "lists")
    counts = {r[0]: r[1] for r in lists.groupBy("list").count().collect()}  # one row per centroid at most
    sizes = np.array([counts.get(i, 0) for i in range(len(centers))])

    queries = vectors.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    ratio = max(LIST_RATIO, fitted_ratio(stored, queries, centers, top, k)) if list_ratio is None else list_ratio

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, graph = shared.value
        for batch in batches:
            row, chosen, early = [], [], []
            for i, query in enumerate(matrix(batch.column("v"))):
                found = near_lists(np.append(query, 0.0), centers, graph, ratio, 4 * (k + 1), sizes)
                row += [i] * len(found)
                chosen += found
                early += [at < FIRST_LISTS for at in range(len(found))]
            at = pa.array(row, pa.int64())
            columns = [pa.array(chosen, pa.int32()), pa.array(early, pa.bool_()), batch.column("vec_id").take(at), batch.column("v").take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["list", "early", "query_id", "q"])

    asked = kept(queries.mapInArrow(route, "list int, early boolean, query_id long, q binary"), "asked")
    first = kept(answers(asked.filter("early").withColumn("least", F.lit(float("-inf"))), lists, k, top), "first")
    least = ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = asked.filter("not early").join(least, "query_id", "left").fillna(float("-inf"), ["least"])
    return ranked(first.union(answers(rest, lists, k, top)), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of every query, a vector found in several lists once."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answers(asked: DataFrame, lists: DataFrame, k: int, top: float) -> DataFrame:
    """``(query_id, vec_id, score)``: of every asked list, the k best vectors whose score is at least ``least``.

    Long lists and lists with many queries are dealt to blocks; a task holds one block of either.
    """
    plan = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = plan.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "list")
    plan = kept(plan, "plan")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "list").select("list", every("blocks").alias("b"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("p"), "query_id", "q", "least")
    right = lists.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("b"), every("parts").alias("p"), "vec_id", "v")

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if asked.num_rows == 0 or held.num_rows == 0:
            return schema.empty_table()
        ids, points = held["vec_id"].to_numpy(), matrix(held["v"])
        out = []
        names, queries, least = asked["query_id"].to_numpy(), matrix(asked["q"]), asked["least"].to_numpy()
        room = 1e-9 * top
        for start in range(0, len(names), 256):
            rough = queries[start : start + 256] @ points.T
            for i, query in enumerate(queries[start : start + 256], start):
                line = np.where(ids == names[i], -np.inf, rough[i - start])
                some = np.flatnonzero((line >= least[i] - room) & (line > -np.inf))
                if len(some) > k:
                    some = some[line[some] >= np.partition(line[some], -k)[-k] - room]
                exact = (points[some] * query).sum(axis=1)
                order = np.lexsort((ids[some], -exact))[:k]
                order = order[exact[order] >= least[i]]
                out.append((np.full(len(order), names[i]), ids[some][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c) for c in columns], schema=schema)

    return left.groupBy("list", "b", "p").cogroup(right.groupBy("list", "b", "p")).applyInArrow(score, "query_id long, vec_id long, score double")
