"""Rows that are easily lost: repeated and null ids, null clusters, empty tables."""

import pytest

from vectorlens.operators import clustering, evaluation, neighbours, summary
from vectorlens.plans import workflows


@pytest.mark.parametrize("room", [4096, 1])
def test_nearest_of_a_center_table_in_any_number_of_blocks(spark, room):
    rows = [(1, [0.0, 0.0]), (1, [8.0, 9.0]), (2, [0.5, 0.0]), (None, [7.0, 9.0]), (3, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, emb array<float>").selectExpr("'m' as meta", "id", "emb")
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [8.0, 8.0]), (2, [8.0, 8.0])], "k int, c array<double>")
    found = clustering.assign_to_table(df, centers, "id", "emb", "k", "c", rows_per_block=room, centers_per_block=room)
    assert found.columns == ["meta", "id", "emb", "cluster", "dist2"]
    assert sorted((str(r["id"]), r["cluster"], r["dist2"]) for r in found.collect()) == [
        ("1", 0, 0.0), ("1", 1, 1.0), ("2", 0, 0.25), ("3", 0, 32.0), ("None", 1, 2.0),
    ]


def test_center_without_an_id(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [9.0]), (3, None)], "id long, emb array<float>")
    centers = spark.createDataFrame([(None, [0.0]), (5, [0.0]), (None, [9.0])], "k int, c array<double>")
    found = clustering.assign_to_table(df, centers, "id", "emb", "k", "c").collect()
    assert sorted((r["id"], r["cluster"], r["dist2"]) for r in found) == [(1, 5, 0.0), (2, None, 0.0), (3, None, None)]
    with pytest.raises(ValueError, match="no centers"):
        clustering.assign_to_table(df, centers.limit(0), "id", "emb", "k", "c")


def test_labels_of_repeated_and_null_ids_are_carried_once(spark):
    new = spark.createDataFrame([(1, 0), (1, 1), (None, 2), (None, 3), (4, 4)], "uuid long, n int")
    old = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (4, "c"), (4, "d")], "uuid long, `KMeans (k=2)` string")
    found = clustering.carry_label_columns(new, old).collect()
    assert sorted((r["n"], r["KMeans (k=2)"]) for r in found) == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, None)]


@pytest.mark.parametrize("method", ["PCA", "UMAP"])
def test_rows_in_are_rows_out(spark, method):
    rows = [(i, [float(i), 1.0, float(i % 3)]) for i in (1, 2, 3, 4)] + [(None, [5.0, 1.0, 0.0]), (2, [2.5, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "uuid long, emb array<float>")
    wanted = sorted(str(i) for i, _ in rows)
    spec = {"cluster_spec": {"n_clusters": 2}, "dim_reduction_spec": {"method": method, "iterations": 1}}
    frames = [workflows.reduce_vectors(df, method, iterations=1), workflows.cluster_and_project(df, 2, method), workflows.batch_frame(df, spec)]
    assert [sorted(str(r["uuid"]) for r in f.collect()) for f in frames] == [wanted] * 3


def test_rows_without_a_cluster_are_composed_too(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (None, "a"), (None, "a"), (None, "c")], "cluster int, kind string")
    found = [tuple(r)[:3] for r in evaluation.composition(df, "cluster", "kind").collect()]
    assert sorted(found, key=repr) == sorted([("0", "a", 1), ("0", "b", 1), (None, "a", 2), (None, "c", 1)], key=repr)
    lines = [r["line"] for r in evaluation.composition_tree(df, "cluster", "kind").orderBy("line_no").collect()]
    assert lines[0].startswith("KMeans Clustering Summary (5 points, 2 clusters)")
    assert lines[3].startswith("├── Cluster 0") and lines[6].startswith("└── Cluster none") and len(lines) == 9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "uuid long, emb array<float>, cluster int")
    assert summary.representatives(empty, "cluster").collect() == []
    assert neighbours.knn_graph(empty, 2, "uuid", "emb").collect() == []
