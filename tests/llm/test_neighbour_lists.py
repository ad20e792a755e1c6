import numpy as np
import pytest

from vectorlens.llm import neighbour_lists as lists


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, v string, b int")


def exact(rows, k, every):
    best = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    out = {}
    for q, vectors in best.items():
        if q % every:
            continue
        own = min(vectors, key=lambda v: v.astype("<f8").tobytes())
        found = sorted((-max(float((own * v).sum()) for v in vs), i) for i, vs in best.items() if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def results(df, **more):
    out = {}
    for r in sorted(lists.nearest(df, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def clustered(n, width, seed=1, groups=20):
    random = np.random.RandomState(seed)
    centers = random.randn(groups, width)
    points = centers[random.randint(groups, size=n)] + 0.6 * random.randn(n, width)
    return [(i, [float(x) for x in p], "x", "y", 0) for i, p in enumerate(points)]


def recall(found, wanted):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items()])


@pytest.mark.parametrize("kind", ["clustered", "no structure"])
def test_recall_order_and_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(lists, "ROWS_PER_LIST", 40)
    rows = clustered(1500, 16, groups=20 if kind == "clustered" else 1500)
    found, wanted = results(table(spark, rows)), exact(rows, 20, 20)
    assert set(found) == set(wanted) and all(len(v) == 20 for v in found.values())
    assert recall(found, wanted) >= 0.9
    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in rows}
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - by_id[q] @ by_id[i]) < 1e-9 for i, s in near)


@pytest.mark.parametrize("n, per_list", [(1000, 40), (6000, 10), (9000, 10)])
def test_recall_does_not_fall_with_the_table(spark, monkeypatch, n, per_list):
    # No structure, and few vectors of the sample for a list; at the larger sizes a walk does not hold all centroids.
    monkeypatch.setattr(lists, "ROWS_PER_LIST", per_list)
    monkeypatch.setattr(lists, "BEAM", 64)
    monkeypatch.setattr(lists, "SAMPLE_BYTES", 65 * 8 * 2000)
    random = np.random.RandomState(8)
    points = random.randn(n, 64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in p], "x", "y", 0) for i, p in enumerate(points.astype(np.float32))]
    assert recall(results(table(spark, rows), query_every=100), exact(rows, 20, 100)) >= 0.92


def test_common_vector_blocks_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 16)
    rows = clustered(300, 8)
    rows += [(1000 + i, [1.0] * 8, "x", "y", 0) for i in range(200)]
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [float("inf")] * 8), (2080, [None] + [1.0] * 7), (2100, [1.0] * 3), (None, [1.0] * 8)]
    rows += [(*b, "x", "y", 0) for b in bad] + [rows[0], rows[20], (40, [2.0] * 8, "x", "y", 0)]
    found = results(table(spark, rows))
    assert not {b[0] for b in bad} & (set(found) | {i for near in found.values() for i, _ in near})
    wanted = exact([r for r in rows if r[0] != 2100], 20, 20)
    assert found.keys() == wanted.keys()
    assert {q: [i for i, _ in w] for q, w in found.items()} == {q: [i for i, _ in w] for q, w in wanted.items()}


def test_few_and_no_rows(spark):
    rows = clustered(5, 4)
    assert {q: len(w) for q, w in results(table(spark, rows)).items()} == {0: 4}
    assert results(table(spark, rows[:1])) == {} and results(table(spark, [])) == {}


def test_graph_walk_finds_the_nearest_centroids():
    points = np.random.RandomState(2).randn(3000, 8)
    graph = lists.centroid_graph(points)
    hits = []
    for query in np.random.RandomState(3).randn(30, 8):
        found = [c for _, c in lists.search_graph(query, points, graph, beam=64)][:10]
        hits.append(len(set(found) & set(np.argsort(((points - query) ** 2).sum(axis=1))[:10].tolist())) / 10)
    assert np.mean(hits) > 0.95


def test_centroids_are_balanced():
    random = np.random.RandomState(1)
    points = np.vstack((random.randn(3000, 4) * 0.01, random.randn(300, 4) * 5))
    centers = lists.fit_centroids(points, 20)
    sizes = np.bincount(lists.distances(points, centers).argmin(axis=1), minlength=len(centers))
    assert sizes.max() < 1200
