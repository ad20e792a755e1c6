import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorlens.catalog import graphs
from vectorlens.operators import descent, layout, neighbours


def brute(points, ids, k):
    """Neighbours by (distance, id) on normalized float vectors."""
    points = points.astype(np.float32).astype(np.float64)
    norms = np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-10)
    ready = (points / norms).astype(np.float32).astype(np.float64)
    out = {}
    for i, own in enumerate(ids):
        d = np.sqrt(((ready - ready[i]) ** 2).sum(axis=1))
        order = sorted((d[j], other) for j, other in enumerate(ids) if j != i)
        out[own] = [other for _, other in order[:k]]
    return out


def found(graph):
    out = {}
    for r in graph.sort("src", "rank").collect():
        out.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    for rows in out.values():
        assert [rank for rank, _, _ in rows] == list(range(1, len(rows) + 1))
        assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]))
    return {src: [dst for _, dst, _ in rows] for src, rows in out.items()}


@pytest.mark.parametrize("block_rows", [4096, 50, 13])
def test_exact_graph(vectors_frame, block_rows):
    points = np.random.RandomState(1).randn(300, 6)
    graph = neighbours.knn_graph(vectors_frame(points), 7, block_rows=block_rows)
    assert found(graph) == brute(points, list(range(300)), 7)


def test_separated_groups_are_pruned_but_exact(vectors_frame, blobs):
    points, _ = blobs
    graph = neighbours.knn_graph(vectors_frame(points), 5, block_rows=10)
    assert found(graph) == brute(points, list(range(60)), 5)


def test_copies_share_one_search(vectors_frame):
    """A third of all rows is one vector, and more groups of copies stand around it."""
    random = np.random.RandomState(3)
    points = random.randn(120, 5)
    points[::3] = points[0]
    points[1::12] = points[1]
    points[[5, 8]] = 0.0
    ids = [f"id{(i * 37) % 120:03d}" for i in range(120)]
    for block_rows in (4096, 20):
        graph = neighbours.knn_graph(vectors_frame(points, ids), 4, block_rows=block_rows)
        assert found(graph) == brute(points, ids, 4)


def test_heavy_copies_are_salted(vectors_frame, monkeypatch):
    points = np.random.RandomState(4).randn(60, 4)
    points[:40] = points[0]
    monkeypatch.setattr(neighbours, "HEAVY_ROWS", 5)
    monkeypatch.setattr(neighbours, "MAX_HEAVY", 10)
    assert found(neighbours.knn_graph(vectors_frame(points), 3)) == brute(points, list(range(60)), 3)


def test_default_size_and_tiny_tables(vectors_frame):
    points = np.random.RandomState(5).randn(4, 3)
    assert found(neighbours.knn_graph(vectors_frame(points))) == brute(points, [0, 1, 2, 3], 3)
    assert neighbours.knn_graph(vectors_frame(points[:1])).count() == 0
    assert neighbours.umap_neighbours(1000) == 15 and neighbours.umap_neighbours(2) == 2
    assert [neighbours.tsne_perplexity(n) for n in (6, 60, 1000)] == [5, 20, 30]


@pytest.fixture(scope="module")
def graph(vectors_frame):
    points = np.random.RandomState(6).randn(80, 5)
    return neighbours.knn_graph(vectors_frame(points), 15).cache()


def test_membership_strengths_sum_to_log2_k(graph):
    rows = neighbours.adjacency(graph).withColumn("w", neighbours.fuzzy_membership(F.col("dist"))).collect()
    assert len(rows) == 80
    for r in rows:
        assert sum(r["w"]) == pytest.approx(math.log2(15), abs=1e-6)
        assert max(r["w"]) == 1.0 and min(r["w"]) > 0


def test_fuzzy_weights_are_symmetric(graph):
    weights = {(r["src"], r["dst"]): r["w"] for r in neighbours.fuzzy_weights(graph).collect()}
    assert all(weights[(b, a)] == w and 0 < w <= 1 for (a, b), w in weights.items())
    single = {}
    for r in neighbours.adjacency(graph).withColumn("w", neighbours.fuzzy_membership(F.col("dist"))).collect():
        single.update({(r["src"], d): w for d, w in zip(r["dst"], r["w"])})
    for (a, b), w in weights.items():
        x, y = single.get((a, b), 0.0), single.get((b, a), 0.0)
        assert w == pytest.approx(x + y - x * y)


def test_perplexity_affinities(graph):
    p = {(r["src"], r["dst"]): r["p"] for r in neighbours.perplexity_affinities(graph, 80, 5).collect()}
    assert sum(p.values()) == pytest.approx(1.0)
    assert all(p[(b, a)] == pytest.approx(v) for (a, b), v in p.items())
    rows = neighbours.adjacency(graph).withColumn("w", neighbours.gaussian_affinity(F.col("dist"), 5)).collect()
    for r in rows:
        assert -sum(w * math.log(w) for w in r["w"] if w > 0) == pytest.approx(math.log(5), abs=1e-6)


def preserved(points, coordinates, k=5):
    high, low = brute(points, list(range(len(points))), k), {}
    for i in range(len(points)):
        d = ((coordinates - coordinates[i]) ** 2).sum(axis=1)
        low[i] = [j for j in np.argsort(d, kind="stable") if j != i][:k]
    return np.mean([len(set(high[i]) & set(low[i])) / k for i in high])


@pytest.mark.parametrize("method", ["UMAP", "tsne"])
def test_layout_keeps_neighbours_better_than_its_start(vectors_frame, method):
    """Six groups in more dimensions than two: a linear projection must mix some of them."""
    random = np.random.RandomState(8)
    truth = np.repeat(np.arange(6), 15)
    points = (np.eye(10)[truth] * 4 + random.randn(90, 10) * 0.5).astype(np.float32)
    df = vectors_frame(points)

    def coordinates(iterations):
        placed = layout.neighbour_layout(df, method, iterations=iterations).sort("uuid").collect()
        return np.array([(r["x"], r["y"]) for r in placed])

    start, end = coordinates(0), coordinates(12)
    assert end.shape == (90, 2) and np.isfinite(end).all()
    assert preserved(points, end) > preserved(points, start)


@pytest.mark.parametrize("axes", [1, 2, 3, 4])
def test_pyramid_covers_every_other_point_once(axes):
    points = np.random.RandomState(axes).uniform(-4.0, 4.0, (250, axes))
    levels, grid = layout.levels_for(axes), min(axes, layout.GRID_AXES)
    cells = np.ravel_multi_index(tuple(layout.finest_cells(points, grid, 4.0, levels).T), (1 << levels,) * grid)
    mass, sums = np.zeros((1 << levels) ** grid), np.zeros(((1 << levels) ** grid, axes))
    np.add.at(mass, cells, 1.0)
    np.add.at(sums, cells, points)
    pyramid = layout.Pyramid(mass, sums, 4.0, levels)
    groups = list(pyramid.near_and_far(points))
    np.testing.assert_allclose(sum(np.bincount(rows, m, 250) for rows, _, m in groups), 249.0)
    # The mean of all gaps, weighted by the sizes, is exact whatever the cells.
    total = np.zeros_like(points)
    for rows, gap, m in groups:
        np.add.at(total, rows, gap * m[:, None])
    np.testing.assert_allclose(total, 250 * points - points.sum(axis=0), atol=1e-8)
    assert pyramid.mass[0].sum() == 250


@pytest.mark.parametrize("method, rows", [("UMAP", 20), ("TSNE", 20), ("UMAP", 7)])
def test_blocks_exchange_places_and_forces(vectors_frame, blobs, method, rows):
    """Points in many blocks still come apart by group: what one block knows of another reaches it."""
    points, truth = blobs
    placed = layout.neighbour_layout(vectors_frame(points), method, layout_rows=rows).sort("uuid").collect()
    found = np.array([(r["x"], r["y"]) for r in placed])
    assert found.shape == (60, 2) and np.isfinite(found).all()
    apart = ((found[:, None] - found[None]) ** 2).sum(axis=2) + np.eye(60) * 1e9
    assert np.mean(truth[apart.argmin(axis=1)] == truth) > 0.9


def test_edges_belong_to_the_end_with_fewer(spark):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 30)] + [(1, 2, 0.5)], "src long, dst long, w double")
    homes = spark.createDataFrame([(i, i // 10) for i in range(30)], "key long, block int")
    fixed = {r["block"]: r for r in layout._fixed_parts(edges, homes).collect()}
    owned = [(s, d, w) for r in fixed.values() for s, d, w in zip(r["src"], r["dst"], r["w"])]
    assert len(owned) == 30 and all(s != 0 for s, _, _ in owned)
    assert sorted(fixed[0]["asks"]) == [1, 2] and fixed[0]["asked"] == [0, 0]


def test_layout_with_repeated_and_null_ids(spark, blobs):
    rows = [(None if i % 7 == 0 else i // 2, [float(x) for x in p]) for i, p in enumerate(blobs[0])]
    df = spark.createDataFrame(rows, "uuid long, emb array<float>")
    for graph in ("exact", "refined"):
        placed = layout.neighbour_layout(df, iterations=1, graph=graph).collect()
        assert sorted(str(r["uuid"]) for r in placed) == sorted(str(i) for i, _ in rows)


def test_refined_graph_finds_the_exact_one(spark, vectors_frame):
    random = np.random.RandomState(4)
    points = (random.randn(12, 8)[random.randint(12, size=700)] * 3 + random.randn(700, 8)).astype(np.float32)
    df = vectors_frame(points)
    refined = descent.refine(df, 8, block_rows=60)
    found, expected = {}, brute(points, list(range(700)), 8)
    for r in refined.graph.collect():
        found.setdefault(r["src"], {})[r["rank"]] = (r["dst"], r["dist"])
    assert all(sorted(found[i]) == list(range(1, 9)) for i in range(700))
    assert np.mean([len({d for d, _ in found[i].values()} & set(expected[i])) / 8 for i in range(700)]) > 0.95
    for i in (0, 99, 500):
        for d, dist in found[i].values():
            ready = points[[i, d]] / np.linalg.norm(points[[i, d]], axis=1, keepdims=True)
            assert d != i and dist == pytest.approx(np.linalg.norm(ready[0] - ready[1]), abs=1e-5)
    assert refined.comparisons < 700 * 4


def test_refined_graph_of_copies_odd_ids_and_small_tables(spark):
    rows = [(None if i % 5 == 0 else 1, [1.0, 2.0]) for i in range(40)] + [(7, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "uuid long, emb array<float>")
    edges = descent.knn_descent(df, 3, block_rows=10, normalize=False).collect()
    assert len(edges) == 70 * 3 and sum(r["dist"] == 0.0 for r in edges) >= 40 * 3
    for few in (0, 1):
        assert descent.knn_descent(df.limit(few), 3).collect() == []
    assert len(descent.knn_descent(df.limit(2), 3).collect()) == 2


def test_refined_graph_over_many_tiles(spark, vectors_frame, monkeypatch):
    """Pairs of one list meet in the tile of their regions, copies and members of one region included."""
    monkeypatch.setattr(descent, "LEAST_ROWS", 40)
    monkeypatch.setattr(descent, "PAIRS", 500)
    random = np.random.RandomState(14)
    points = (random.randn(10, 6)[random.randint(10, size=400)] * 3 + random.randn(400, 6)).astype(np.float32)
    points[::25] = points[3]
    refined = descent.refine(vectors_frame(points), 6, block_rows=40, normalize=False)
    found = {}
    for r in refined.graph.collect():
        found.setdefault(r["src"], {})[r["rank"]] = r["dist"]
    whole = np.sqrt(((points[:, None, :].astype(np.float64) - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(whole, np.inf)
    whole.sort(axis=1)
    assert all(sorted(found[i]) == list(range(1, 7)) for i in range(400))
    near = [found[i][r] <= whole[i, r - 1] + 1e-9 for i in range(400) for r in range(1, 7)]
    assert np.mean(near) > 0.95 and all(found[i][r] >= whole[i, r - 1] - 1e-9 for i in range(400) for r in range(1, 7))


def test_vectors_of_refined_graph_travel_once_to_a_tile(vectors_frame, monkeypatch):
    """However many blocks and lists there are, a round deals each vector to the tiles of its region and no further."""
    dealt = []

    def spy(df, number, *columns):
        if "v" in df.columns:
            dealt.append(df.count())
        return repartition(df, number, *columns)

    points = np.random.RandomState(15).randn(1200, 6).astype(np.float32)
    df = vectors_frame(points)
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", spy)
    descent.refine(df, 10, block_rows=15, rounds=1)
    assert dealt and max(dealt) <= 4 * 1200


def test_layout_rejects_other_methods(vectors_frame, few_points):
    with pytest.raises(ValueError):
        layout.neighbour_layout(vectors_frame(few_points), "ISOMAP")


def test_small_cells_share_a_region():
    """A query travels once to every region it visits, however many cells and blocks the region holds."""
    centers = np.random.RandomState(8).randn(800, 16)
    regions_of, regions = neighbours._regions(centers, dict.fromkeys(range(800), 128), 131_072)
    assert regions == 1 and set(regions_of.values()) == {(0, 1)}
    rows_of = {cell: 50 + cell for cell in range(100)} | {100: 1000}
    regions_of, regions = neighbours._regions(centers[:101], rows_of, 300)
    held = np.zeros(regions)
    for cell, (first, parts) in regions_of.items():
        held[first : first + parts] += rows_of[cell] / parts
    assert regions_of[100][1] == 4 and (held > 0).all() and (held <= 300).all()


@pytest.mark.parametrize("block_rows", [40, 7])
def test_exact_graph_in_several_regions_and_parts(vectors_frame, monkeypatch, block_rows):
    monkeypatch.setattr(neighbours, "POINT_BYTES", 8 * 6 * 60)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 6 * 25)
    points = np.random.RandomState(9).randn(200, 6)
    points[::10] = points[3]
    points[1::8] = np.round(points[1::8])
    graph = neighbours.knn_graph(vectors_frame(points), 6, block_rows=block_rows)
    assert found(graph) == brute(points, list(range(200)), 6)


def test_points_of_a_cell_share_their_list_of_cells(monkeypatch):
    """What is looked up for a layout grows with the cells that hold points, not with the points."""
    points = np.random.RandomState(3).uniform(0.1, 0.11, (3000, 2))
    levels = layout.levels_for(2)
    cells = np.ravel_multi_index(tuple(layout.finest_cells(points, 2, 4.0, levels).T), (1 << levels,) * 2)
    mass, sums = np.zeros(1 << 2 * levels), np.zeros((1 << 2 * levels, 2))
    np.add.at(mass, cells, 1.0)
    np.add.at(sums, cells, points)
    looked, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda a, *rest: looked.append(np.size(a)) or clip(a, *rest))
    met = sum(m.sum() for _, _, m in layout.Pyramid(mass, sums, 4.0, levels).near_and_far(points))
    assert met == 3000 * 2999 and max(looked) <= points.size


def test_rows_that_have_met_their_target_are_not_halved_again():
    asked = []

    def level(scale, rows):
        asked.append(len(rows))
        return scale

    found = neighbours._bisect(level, 0.75, 40)
    np.testing.assert_allclose(found, 0.75)
    assert len(asked) < 100


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 500.0), (1e-15, 0.0), (1e13, 0.0)])
def test_search_in_single_precision_finds_the_exact_neighbours(scale, offset):
    random = np.random.RandomState(12)
    points = (random.randn(900, 6) * scale + offset).astype(np.float32).astype(np.float64)
    points[::30] = points[4]
    rough = neighbours._Rough(points[:50], points)
    assert rough.points.dtype == (np.float32 if 1e-9 < scale < 1e9 else np.float64)
    where, dist = neighbours.vectors.closest(points[:50], points, 4)
    row, col, d2 = neighbours._within_reach(points[:50], np.sqrt(dist[:, -1]), points, 4, (rough.queries, rough.norms, rough.points, rough.room))
    nearest = neighbours._Nearest(50, 4)
    nearest.add(row, col, d2)
    assert (nearest.where == where).all() and (nearest.dist == dist).all()


def test_layout_facts_compares_all_pairs_of_vectors_once(spark, tmp_path, blobs, monkeypatch):
    points, _ = blobs
    ids = [None, 7, 7, *range(100, 157)]
    rows = [(i, [float(v) for v in p]) for i, p in zip(ids, points, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, plans = [], []
    knn_graph, kept = neighbours.knn_graph, graphs._kept

    def spy(df, k=None, id_col="uuid", vec_col="emb", block_rows=neighbours.BLOCK_ROWS, seed=0, normalize=True):
        calls.append(normalize)
        return knn_graph(df, k, id_col, vec_col, block_rows, seed, normalize)

    def kept_spy(placed, axes, exact):
        plans.append(exact._jdf.queryExecution().analyzed().toString())
        return kept(placed, axes, exact)

    monkeypatch.setattr(neighbours, "knn_graph", spy)
    monkeypatch.setattr(graphs, "_kept", kept_spy)
    found = {r["method"]: r["placed"] for r in graphs.layout_facts(spark, str(tmp_path)).collect()}
    assert found == {"UMAP": 59, "TSNE": 59}
    # Pictures are compared without normalizing. The graph of the vectors is made once and then read.
    assert calls.count(True) == 1 and calls.count(False) == 3
    assert len(plans) == 3 and not any("CoGroup" in plan for plan in plans)


@pytest.mark.parametrize("method", ["UMAP", "TSNE"])
def test_layout_of_a_given_graph(vectors_frame, blobs, method):
    points, _ = blobs
    df = vectors_frame(points)
    graph = neighbours.knn_graph(df, 59)
    given, own = (
        layout.neighbour_layout(df, method, iterations=2, graph=g, key_col="uuid").sort("uuid").collect() for g in (graph, "exact")
    )
    np.testing.assert_allclose([(r["x"], r["y"]) for r in given], [(r["x"], r["y"]) for r in own], rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError):
        layout.neighbour_layout(df, method, graph=graph)


@pytest.mark.parametrize("few, size", [(1, 16), (6, 16), (1000, 16), (1000, 4096)])
def test_cells_are_met_alone_or_several_at_once(monkeypatch, few, size):
    monkeypatch.setattr(neighbours, "FEW", few)
    monkeypatch.setattr(neighbours, "SLICE", size)
    random = np.random.RandomState(21)
    points = random.randn(300, 5).astype(np.float32)
    points[::7] = points[2]
    ids = random.permutation(300) + 10
    centers = points[random.choice(300, 12, replace=False)].astype(np.float64)
    far = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    cell, radii = far.argmin(axis=1).astype(np.int32), np.full(12, -np.inf)
    np.maximum.at(radii, cell, np.sqrt(far.min(axis=1)))
    lists = pa.array(list(points), pa.list_(pa.float32()))
    asked = pa.table({"id": pa.array(ids), "v": lists, "home": pa.array(cell), "reach": pa.array(np.full(300, np.inf))})
    out = neighbours._search_region(centers, radii, 9)(asked, pa.table({"id": pa.array(ids), "v": lists, "cell": pa.array(cell)}))
    lists_of = {}
    for row in out.to_pylist():
        lists_of.setdefault(row["src"], []).append((row["d2"], row["dst"]))
    d2 = ((points.astype(np.float64)[:, None, :] - points.astype(np.float64)[None, :, :]) ** 2).sum(axis=2)
    for i in range(300):
        order = np.lexsort((ids, d2[i]))[:9]
        assert [dst for _, dst in sorted(lists_of[ids[i]])] == ids[order].tolist()
