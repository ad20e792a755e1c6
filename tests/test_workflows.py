import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorlens.plans import workflows


def test_cluster_and_project(vectors_frame, blobs):
    points, truth = blobs
    df = vectors_frame(points).withColumn("path", F.concat(F.lit("/images/img_"), F.col("uuid"), F.lit(".jpg")))
    out = workflows.cluster_and_project(df, 3, "pca", path_col="path", seed=1, index=True)
    assert out.columns == ["idx", "uuid", "x", "y", "cluster", "image_path", "file_name"]
    rows = out.sort("idx").collect()
    assert [r["uuid"] for r in rows] == list(range(60))
    assert rows[7]["file_name"] == "img_7.jpg"
    assert len({(truth[r["uuid"]], r["cluster"]) for r in rows}) == 3


def test_project_keeps_metadata(vectors_frame, few_points):
    df = vectors_frame(few_points).withColumn("tag", F.lit("t"))
    assert workflows.reduce_vectors(df, "PCA").columns == ["uuid", "emb", "tag", "x", "y"]
    assert workflows.reduce_vectors(df, "umap", iterations=1).columns == ["uuid", "emb", "tag", "x", "y"]


@pytest.mark.parametrize("method", ["PCA", "UMAP"])
def test_columns_named_like_results_are_replaced(vectors_frame, few_points, method):
    df = vectors_frame(few_points).withColumns({c: F.lit("old") for c in ("x", "y", "cluster", "dim_1", "cluster_label")})
    assert workflows.reduce_vectors(df, method, iterations=1).select("x").dtypes == [("x", "double")]
    assert workflows.cluster_and_project(df, 2, "PCA").columns == ["uuid", "x", "y", "cluster"]
    spec = {"method": method.lower(), "iterations": 1}
    out = workflows.batch_frame(df, {"cluster_spec": {"n_clusters": 2}, "dim_reduction_spec": spec})
    assert out.columns == ["uuid", "x", "y", "cluster", "dim_1", "dim_2", "cluster_label"]
    assert out.select("dim_1").dtypes == [("dim_1", "double")]


def test_unknown_method(vectors_frame, few_points):
    for call in (workflows.reduce_vectors, lambda df, m: workflows.cluster_and_project(df, 2, m)):
        with pytest.raises(ValueError):
            call(vectors_frame(few_points), "LDA")


def test_job(spark, vectors_frame, many_points, tmp_path):
    source = vectors_frame(many_points).withColumn("kind", F.when(F.col("uuid") < 60, "a").otherwise("b"))
    source.write.parquet(str(tmp_path / "in"))
    config = {
        "data_path": str(tmp_path / "in"),
        "output_dir": str(tmp_path / "out"),
        "filters": {"_description": "membership", "kind": ["a"], "uuid": []},
        "cluster_spec": {"model": "kmeans", "n_clusters": 4, "rnd_state": 42},
        "dim_reduction_spec": {"model": "pca", "n_components": 3},
    }
    path = workflows.run_job(spark, config)
    written = spark.read.parquet(path)
    assert written.columns == ["uuid", "kind", "dim_1", "dim_2", "dim_3", "cluster_label"]
    assert dict(written.dtypes)["cluster_label"] == "string"
    slim = workflows.batch_frame(source, {"cluster_spec": {"n_clusters": 2}}, keep_metadata=False)
    assert slim.dtypes == [("uuid", "bigint"), ("dim_1", "double"), ("dim_2", "double"), ("cluster_label", "int")]
    rows = written.sort("uuid").collect()
    assert len(rows) == 60 and {r["cluster_label"] for r in rows} <= set("0123")
    raw = many_points[:60].astype(np.float64)
    centred = raw - raw.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2]
    np.testing.assert_allclose(np.abs([r["dim_1"] for r in rows]), np.abs(centred @ axes[0]), atol=1e-3)


def test_job_rejects_bad_specs(vectors_frame, few_points):
    df = vectors_frame(few_points)
    for spec in ({"method": "lda"}, {"method": "umap", "n_components": 0}):
        with pytest.raises(ValueError):
            workflows.batch_frame(df, {"dim_reduction_spec": spec})
    with pytest.raises(ValueError, match="k=20"):
        workflows.batch_frame(df, {"cluster_spec": {"n_clusters": 20}})


def test_layout_of_raw_vectors_sees_their_length(vectors_frame, blobs):
    points, _ = blobs
    scaled = points * np.array([1.0, 40.0, 6.0])[np.arange(len(points)) % 3][:, None]

    def placed(matrix, normalize):
        out = workflows.reduce_vectors(vectors_frame(matrix), "UMAP", iterations=2, normalize=normalize)
        return np.array([(r["x"], r["y"]) for r in out.sort("uuid").collect()])

    np.testing.assert_allclose(placed(points, True), placed(scaled, True), atol=1e-3)
    assert np.abs(placed(points, False) - placed(scaled, False)).max() > 0.1


def test_job_from_a_file_with_three_layout_components(spark, vectors_frame, blobs, tmp_path):
    vectors_frame(blobs[0]).write.parquet(str(tmp_path / "in"))
    config = {
        "data_path": str(tmp_path / "in"),
        "output_dir": str(tmp_path / "out"),
        "cluster_spec": {"n_clusters": 3},
        "dim_reduction_spec": {"method": "umap", "n_components": 3, "iterations": 2},
    }
    (tmp_path / "job.json").write_text(json.dumps(config, indent=2))
    written = spark.read.parquet(workflows.run_job(spark, str(tmp_path / "job.json")))
    assert written.columns == ["uuid", "dim_1", "dim_2", "dim_3", "cluster_label"]
    found = np.array([(r["dim_1"], r["dim_2"], r["dim_3"]) for r in written.collect()])
    assert found.shape == (60, 3) and np.isfinite(found).all()
