import numpy as np
import pytest
from frames import values
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.operators import clustering, lloyd, preparation, projection, summary


def matrix(df, column="emb", order="uuid"):
    return np.array([r[0] for r in df.sort(order).select(column).collect()])


def test_prepare_normalizes(vectors_frame, many_points):
    df = preparation.with_prepared(vectors_frame(many_points))
    assert df.schema["emb"].dataType == vectors.VECTOR
    found = matrix(df)
    assert found.shape == (96, 180)
    np.testing.assert_allclose(np.linalg.norm(found, axis=1), 1.0, atol=1e-5)


def test_prepare_replaces_nonfinite_before_the_norm(vectors_frame):
    nan, inf = float("nan"), float("inf")
    found = matrix(preparation.with_prepared(vectors_frame([[2, nan, -6], [inf, 2, 5], [8, -inf, 15], [0, 0, 0]])))
    np.testing.assert_allclose(found[0], np.array([2, 0, -6]) / np.sqrt(40), atol=1e-6)
    np.testing.assert_allclose(found[2], np.array([8, 0, 15]) / 17, atol=1e-6)
    assert not found[3].any()


def test_prepare_doubles_that_overflow_float(spark):
    df = spark.createDataFrame([([1e300, 3.0, None],)], "emb array<double>")
    assert preparation.with_prepared(df).first()["emb"] == [0.0, 1.0, 0.0]


def test_prepare_keeps_null_and_ragged_rows(vectors_frame):
    df = preparation.with_prepared(vectors_frame([[3.0, 4.0], None, [2.0], []]))
    assert [r["emb"] for r in df.sort("uuid").collect()] == [pytest.approx([0.6, 0.8]), None, [1.0], []]


def test_report(vectors_frame):
    row = preparation.report(vectors_frame([[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0]])).first()
    assert (row["n"], row["d"], row["n_nonfinite"], row["n_near_zero"]) == (3, 2, 1, 1)
    assert (row["norm_min"], row["norm_max"], row["norm_mean"]) == (0.0, 5.0, 2.0)


def test_memory_estimate(spark):
    df = spark.range(1).select(*[preparation.memory_mb(F.lit(10000), F.lit(512), m) for m in ("PCA", "TSNE", "umap", "x")])
    assert tuple(df.first()) == (39, 459, 59, 58)


def test_kmeans_finds_groups(vectors_frame, blobs):
    points, truth = blobs
    df = vectors_frame(points)
    first = {r["uuid"]: r["prediction"] for r in clustering.kmeans_labels(df, 3, seed=42).collect()}
    again = {r["uuid"]: r["prediction"] for r in clustering.kmeans_labels(df, 3, seed=42).collect()}
    assert first == again
    assert len({(truth[i], label) for i, label in first.items()}) == 3


def test_kmeans_rejects_bad_k(vectors_frame, few_points):
    df = vectors_frame(few_points)
    for k in (11, 0, -1):
        with pytest.raises(ValueError):
            clustering.kmeans(df, k)


def test_label_columns_side_by_side(vectors_frame, few_points):
    df = vectors_frame(few_points)
    for k in (3, 2, 3):
        df = clustering.add_label_column(df, clustering.kmeans(df, k, seed=1), k)
    assert df.columns == ["uuid", "emb", "KMeans (k=3)", "KMeans (k=2)"]
    assert dict(df.dtypes)["KMeans (k=2)"] == "string"


def test_carry_label_columns_by_id(spark):
    old = spark.createDataFrame([(1, "0"), (2, "1")], "uuid int, `KMeans (k=2)` string")
    new = spark.createDataFrame([(2, 0.5), (3, 0.1)], "uuid int, x double")
    assert values(clustering.carry_label_columns(new, old)) == [(2, 0.5, "1"), (3, 0.1, None)]
    assert clustering.carry_label_columns(new, new).columns == ["uuid", "x"]


def test_assign_nearest_breaks_ties_by_id(vectors_frame):
    df = vectors_frame([[0.0, 0.0], [2.0, 0.0]])
    near = clustering.assign_nearest(df, [4, 7], np.array([[1.0, 0.0], [-1.0, 0.0]]))
    assert values(near, "uuid", "cluster", "dist2") == [(0, 4, 1.0), (1, 4, 1.0)]


def test_center_table_is_size_checked(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0] * 10) for i in range(5)], "k int, c array<double>")
    ids, centers = clustering.collect_centers(df, "k", "c")
    assert ids == [0, 1, 2, 3, 4] and centers.shape == (5, 10)
    monkeypatch.setattr(clustering, "MAX_CENTER_BYTES", 100)
    with pytest.raises(ValueError):
        clustering.collect_centers(df, "k", "c")


def test_split_centers_give_the_same_assignment(spark, vectors_frame, many_points, monkeypatch):
    points = many_points[:, :6]
    df = vectors_frame(points)
    rows = [(k, [float(v) for v in points[k * 4]]) for k in range(20)] + [(30, [float(v) for v in points[0]])]
    centers = spark.createDataFrame(rows, "k int, c array<double>")
    whole = values(clustering.assign_to_table(df, centers, "uuid", "emb", "k", "c"), "uuid", "cluster", "dist2")
    assert whole[0] == (0, 0, 0.0)
    split = values(clustering.assign_to_table(df, centers, "uuid", "emb", "k", "c", 10, 4), "uuid", "cluster", "dist2")
    assert split == whole


def plain_lloyd(points, k):
    centers = points[:k].copy()
    while True:
        near = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.array([points[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(k)])
        if np.abs(after - centers).max() < 1e-12:
            return near, after
        centers = after


@pytest.mark.parametrize("k, share", [(1, 0.4), (2, 0.4), (7, 0.4), (7, 0.01), (7, 1.0)])
def test_lloyd_reaches_the_fixed_point(vectors_frame, monkeypatch, k, share):
    monkeypatch.setattr(lloyd, "ANCHOR_SHARE", share)
    random = np.random.RandomState(3)
    points = (random.randn(7, 6)[random.randint(7, size=400)] * 4 + random.randn(400, 6)).astype(np.float32)
    df = vectors_frame(points)
    fitted = clustering.lloyd_kmeans(df, k, normalize=False)
    near, centers = plain_lloyd(points.astype(np.float64), k)
    np.testing.assert_allclose(fitted.centers, centers, atol=1e-6)
    assert [r["prediction"] for r in fitted.label(df).sort("uuid").collect()] == near.tolist()
    assert fitted.rows == 400 and ((k, share) != (7, 0.4) or fitted.searched < 0.8 * 400 * fitted.rounds)


def test_lloyd_with_copies_empty_centers_and_null_vectors(vectors_frame):
    df = vectors_frame([[1.0, 1.0]] * 5 + [[4.0, 4.0]] * 3 + [None])
    fitted = clustering.lloyd_kmeans(df, 3, normalize=False)
    # All start alike, so that the first takes every row; then the copies go back to the second, and the third stays empty.
    np.testing.assert_allclose(fitted.centers, [[4.0, 4.0], [1.0, 1.0], [1.0, 1.0]])
    assert fitted.rows == 8 and fitted.k == 3


def test_one_cluster_is_the_mean(vectors_frame, few_points):
    df = vectors_frame(few_points)
    fitted = clustering.kmeans(df, 1, normalize=False)
    np.testing.assert_allclose(fitted.centers[0], few_points.astype(np.float64).mean(axis=0), atol=1e-6)
    assert {r["prediction"] for r in fitted.label(df).collect()} == {0}


def test_range_finder_agrees_with_the_covariance(vectors_frame, many_points):
    df = vectors_frame(many_points[:, :60]).repartition(5)
    exact, found = projection.pca(df, 3, normalize=False), projection.pca(df, 3, normalize=False, wide=10)
    np.testing.assert_allclose(found.components, exact.components, atol=1e-5)
    np.testing.assert_allclose(found.explained, exact.explained, atol=1e-8)
    np.testing.assert_allclose(found.mean, exact.mean, atol=1e-8)


@pytest.mark.parametrize("normalize", [True, False])
def test_pca_matches_numpy(vectors_frame, few_points, normalize):
    points = few_points.astype(np.float64) + (0 if normalize else 1000)
    points = points.astype(np.float32).astype(np.float64)
    df = vectors_frame(points)
    fitted = projection.pca(df, 3, normalize=normalize)
    scored = fitted.project(df, ["a", "b", "c"]).sort("uuid")
    found = np.array([tuple(r) for r in scored.select("a", "b", "c").collect()])
    ready = points / np.linalg.norm(points, axis=1, keepdims=True) if normalize else points
    centred = ready - ready.mean(axis=0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(np.abs(found), np.abs(centred @ axes[:3].T), atol=1e-5)
    np.testing.assert_allclose(found.mean(axis=0), 0, atol=1e-6)
    np.testing.assert_allclose(fitted.components.T @ fitted.components, np.eye(3), atol=1e-9)
    np.testing.assert_allclose(fitted.explained, (sizes**2 / (sizes**2).sum())[:3], atol=1e-6)
    assert (fitted.components[np.abs(fitted.components).argmax(axis=0), range(3)] > 0).all()


def test_pca_limits(vectors_frame, few_points):
    with pytest.raises(ValueError):
        projection.pca(vectors_frame(few_points), 11)
    with pytest.raises(ValueError):
        projection.pca(vectors_frame(few_points).filter("false"), 2)


def test_cluster_summary_and_representatives(vectors_frame, few_points):
    df = vectors_frame(few_points).withColumn("label", F.col("uuid") % 3)
    rows = {r["Cluster"]: r for r in summary.cluster_summary(df, "label").collect()}
    assert sum(r["Count"] for r in rows.values()) == 10
    for label, row in rows.items():
        members = few_points[np.arange(10) % 3 == label].astype(np.float64)
        spread = ((members - members.mean(axis=0)) ** 2).sum(axis=1)
        assert row["Variance"] == pytest.approx(spread.mean(), abs=6e-4)
        chosen = summary.representatives(df, "label").filter(F.col("cluster") == label).sort("rank").collect()
        expected = np.flatnonzero(np.arange(10) % 3 == label)[np.argsort(spread)[:3]]
        assert [r["uuid"] for r in chosen] == expected.tolist()


def test_singletons_have_no_variance(vectors_frame):
    df = vectors_frame([[0.5, -2.0], [7.0, 1.5], [-3.0, 9.0], [2.0, 2.0]]).withColumn("label", F.col("uuid").cast("string"))
    assert [r["Variance"] for r in summary.cluster_summary(df, "label").collect()] == [0.0] * 4


def test_representatives_without_small_centers(vectors_frame, few_points, monkeypatch):
    """A label column with too many values for every task is joined; the result is the same."""
    df = vectors_frame(few_points).withColumn("label", F.col("uuid") % 4)
    small = values(summary.representatives(df, "label"), "cluster", "rank", "uuid")
    monkeypatch.setattr(summary, "MAX_CENTER_BYTES", 8)
    assert values(summary.representatives(df, "label"), "cluster", "rank", "uuid") == small


def test_many_small_blocks_make_few_tasks(spark, vectors_frame, many_points, monkeypatch):
    """Blocks share tasks: a row travels once to each task that needs it, not once to every block of centers."""
    rows, centers = clustering._parts(100_000, 34_000, 64, 200, 60)
    assert centers == 1 and rows == clustering.TASKS
    rows, centers = clustering._parts(600_000, 200_000, 64, 200, 60)
    assert centers <= 4 and rows <= 12
    points = many_points[:, :6]
    df = vectors_frame(points)
    table = spark.createDataFrame([(k, [float(v) for v in points[k * 3]]) for k in range(30)], "k int, c array<double>")
    near = ((points[:, None].astype(float) - points[None, :90:3].astype(float)) ** 2).sum(axis=2)
    # Parts of several blocks on both sides.
    monkeypatch.setattr(clustering, "TASK_BYTES", 20 * 8 * 6)
    assert clustering._parts(96, 30, 6, 7, 4) == (12, 2)
    found = clustering.assign_to_table(df, table, "uuid", "emb", "k", "c", 7, 4).collect()
    assert {r["uuid"]: r["cluster"] for r in found} == dict(enumerate(near.argmin(axis=1).tolist()))


def test_nearest_with_ties_and_elements_that_are_not_finite():
    random = np.random.RandomState(5)
    for turn in range(6):
        points, centers = (random.randint(-2, 3, (n, 3)).astype(float) for n in (300, 50))
        if turn % 2:
            points[::9, 0], points[1::9, 1], centers[::7, 2] = np.nan, np.inf, np.nan
        with np.errstate(all="ignore"):
            where, dist = clustering._nearest(points, centers, 7 + turn)
            all_of = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
        best = np.argsort(all_of, axis=1, kind="stable")[:, 0]
        assert (where == best).all() and np.array_equal(dist, all_of[np.arange(300), best], equal_nan=True)
