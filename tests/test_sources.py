import os
import sys

import numpy as np
import pytest
from frames import values
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vectorlens.sources import images, sinks, tables


@pytest.fixture
def table_path(mixed, tmp_path):
    path = str(tmp_path / "table")
    mixed.write.parquet(path)
    return path


def test_load(spark, table_path):
    df = tables.load_embeddings(spark, table_path, filters={"species": ["cat"], "_note": "x"}, unique_ids=True)
    assert df.count() == 8
    assert tables.check_loaded(df) == 8
    assert tables.load_embeddings(spark, [table_path, table_path]).count() == 40
    with pytest.raises(ValueError, match="occurs"):
        tables.load_embeddings(spark, [table_path, table_path], unique_ids=True)


def test_filters_reach_the_scan(spark, table_path):
    df = tables.load_embeddings(spark, table_path, filters={"species": ["cat"]}, validate=False)
    plan = tables.metadata_only(df)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(species), EqualTo(species,cat)]" in plan or "In(species" in plan
    scan = plan.split("ReadSchema:")[-1]
    assert "emb" not in scan


def test_hive_partitions(spark, mixed, tmp_path):
    path = str(tmp_path / "hive")
    mixed.write.partitionBy("species").parquet(path)
    df = tables.load_embeddings(spark, path, filters={"species": ["dog"]})
    assert df.count() == 8
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "species" in plan.split("PartitionFilters:")[-1].splitlines()[0]


def test_load_rejects_bad_tables(spark, vectors_frame, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(spark.range(1), "uuid", "emb")
    with pytest.raises(ValueError, match="not a vector"):
        tables.require_columns(spark.createDataFrame([("a", "b")], "uuid string, emb string"), "uuid", "emb")
    for bad, message in (([], "no rows"), ([[1.0], None], "no vector"), ([[1.0], [1.0, 2.0]], "mixed")):
        with pytest.raises(ValueError, match=message):
            tables.check_loaded(vectors_frame(bad))


def test_bad_vectors_end_the_first_job_that_reads_them(spark, vectors_frame, tmp_path):
    for name, bad, message in (("n", [[1.0], None], "no vector"), ("w", [[1.0], [1.0, 2.0]], "mixed widths")):
        vectors_frame(bad).coalesce(1).sort("uuid").write.parquet(str(tmp_path / name))
        df = tables.load_embeddings(spark, str(tmp_path / name))
        assert df.select("uuid").count() == 2
        with pytest.raises(Exception, match=message):
            df.collect()
        assert tables.load_embeddings(spark, str(tmp_path / name), validate=False).count() == 2
    vectors_frame([[1.0]]).limit(0).write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError, match="no rows"):
        tables.load_embeddings(spark, str(tmp_path / "e"))


def test_load_checks_are_part_of_one_scan(spark, table_path):
    df = tables.load_embeddings(spark, table_path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "raise_error" in plan


def test_union_of_unequal_parts(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert values(tables.union_parts([a, b])) == [(1, "x", None), (2, None, "y")]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "sub").mkdir(parents=True)
    (root / "a.JPG").write_bytes(b"aaa")
    (root / "b.txt").write_bytes(b"text")
    (root / "broken.png").write_bytes(b"?")
    (root / "sub" / "c.png").write_bytes(b"cc")
    return str(root)


def names(df):
    return [os.path.basename(r["path"]) for r in df.collect()]


def test_list_image_files(spark, folder):
    assert names(images.list_image_files(spark, folder)) == ["a.JPG", "broken.png"]
    assert names(images.list_image_files(spark, folder + "/", recursive=True)) == ["a.JPG", "broken.png", "c.png"]
    assert names(images.list_image_files(spark, folder, (".txt",))) == ["b.txt"]


def test_listing_stays_in_a_folder_and_sees_empty_files(spark, folder):
    root = os.path.join(folder, "deep [a]")
    os.makedirs(os.path.join(root, "x", "y", "z.png"))
    for name in ("one.png", "TWO.Png", "x/three.png", "x/y/four.png"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(b"" if name == "one.png" else b"pp")
    assert names(images.list_image_files(spark, root)) == ["TWO.Png", "one.png"]
    assert names(images.list_image_files(spark, root, recursive=True)) == ["TWO.Png", "one.png", "three.png", "four.png"]
    flat = {os.path.basename(r["path"]): bytes(r["content"]) for r in images.image_files(spark, root).collect()}
    assert flat == {"one.png": b"", "TWO.Png": b"pp"}
    assert images.image_files(spark, root, recursive=True).count() == 4
    assert {r["length"] for r in images.list_files(spark, root).collect()} == {0, 2}
    os.makedirs(os.path.join(root, "none"))
    assert images.image_files(spark, os.path.join(root, "none")).collect() == []


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def byte_encoder():
    def encode(contents):
        assert len(contents) <= 2
        return [np.array([len(c), c[0]]) if c != b"?" else None for c in contents]

    return encode


def test_embed_skips_unreadable_files(spark, folder):
    found = images.embed_image_folder(spark, folder, byte_encoder, recursive=True, batch_size=2)
    assert {os.path.basename(r["path"]): r["emb"] for r in found.collect()} == {"a.JPG": [3.0, 97.0], "c.png": [2.0, 99.0]}
    every = images.embed_contents(images.image_files(spark, folder, recursive=True), byte_encoder, batch_size=2, keep_failed=True)
    assert tuple(images.embedding_counts(every).first()) == (3, 2, 1)
    assert images.embed_contents(every.filter("false").select("path", F.lit(b"").alias("content")), byte_encoder).count() == 0


def test_manifest_flags_collisions(spark):
    df = spark.createDataFrame([("/x/a.jpg", "0"), ("/y/a.jpg", "0"), ("/y/a.jpg", "1")], "image_path string, cluster string")
    found = values(sinks.cluster_manifest(df, "/out/"), "abs_path", "collides")
    assert found == [("/out/cluster_0/a.jpg", True), ("/out/cluster_0/a.jpg", True), ("/out/cluster_1/a.jpg", False)]


def test_copy_by_cluster(spark, folder, tmp_path):
    rows = [(f"file:{folder}/a.JPG", 3), (f"{folder}/sub/c.png", 4), (f"{folder}/absent.png", 4)]
    df = spark.createDataFrame(rows, "image_path string, cluster int")
    target = str(tmp_path / "out")
    manifest = sinks.repartition_by_cluster(df, target)
    assert values(manifest) == [
        (f"{target}/cluster_3/a.JPG", "a.JPG", "3"),
        (f"{target}/cluster_4/c.png", "c.png", "4"),
    ]
    assert (tmp_path / "out" / "cluster_4" / "c.png").read_bytes() == b"cc"
    assert os.path.isdir(f"{target}/cluster_summary.csv")
    saved = sinks.save_clusters(df, [3], str(tmp_path / "saved"))
    assert values(saved, "file_name", "cluster") == [("a.JPG", "3")]
    assert not (tmp_path / "saved" / "cluster_4").exists()


def test_copies_that_collide_fail_or_run_twice(spark, tmp_path):
    for side in ("p", "q"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "same.jpg").write_bytes(side.encode())
    rows = [(str(tmp_path / "p" / "same.jpg"), "0"), (f"file:{tmp_path}/q/same.jpg", "0"), (str(tmp_path / "no.jpg"), "0")]
    df = spark.createDataFrame(rows, "image_path string, cluster string")
    target = str(tmp_path / "out")
    for _ in range(2):  # the second run finds every file and leaves it whole
        written = values(sinks.repartition_by_cluster(df, target), "abs_path", "file_name")
        assert len({path for path, _ in written}) == 2 and {name for _, name in written} == {"same.jpg"}
        assert sorted(open(path, "rb").read() for path, _ in written) == [b"p", b"q"]
        assert sorted(os.listdir(f"{target}/cluster_0")) == sorted(os.path.basename(path) for path, _ in written)
    failed = spark.read.csv(f"{target}/failed_{sinks.REPARTITION_MANIFEST}", header=True).collect()
    assert [r["source"] for r in failed] == [rows[2][0]] and "FileNotFoundError" in failed[0]["reason"]


def test_write_labelled(spark, tmp_path):
    df = spark.createDataFrame([(1, "0"), (2, "1")], "uuid int, cluster_label string")
    path = sinks.write_labelled(df, str(tmp_path), partition_by="cluster_label")
    assert path.endswith("processed_data.parquet")
    assert spark.read.parquet(path).filter("cluster_label = 1").count() == 1
