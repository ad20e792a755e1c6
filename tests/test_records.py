import pytest
from frames import values
from pyspark.sql import functions as F

from vectorlens.functions.bins import nice_bins
from vectorlens.operators import density, profile, records
from vectorlens.operators.ordering import with_row_index


def test_plot_frame_leaves_vectors_out(spark):
    df = spark.createDataFrame(
        [("a", [1], [2], [3], "cat", 1.5, 9), ("b", [1], [2], [3], None, float("nan"), 8)],
        "uuid string, emb array<int>, embedding array<int>, Vector array<int>, species string, w double, idx int",
    )
    frame = records.plot_frame(df.withColumn("px", F.lit(0.5)).withColumn("py", F.lit(1.5)), "px", "py", index=True)
    assert frame.columns == ["idx", "x", "y", "uuid", "species", "w"]
    assert values(frame) == [(0, 0.5, 1.5, "a", "cat", 1.5), (1, 0.5, 1.5, "b", "N/A", None)]


def test_row_index_spans_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = with_row_index(df, [F.col("k")]).collect()
    assert sorted((r["idx"], r["k"]) for r in rows) == [(i, i) for i in range(1000)]


def test_lookup(mixed, spark):
    assert records.lookup(mixed, "uuid", "uuid-0003").first()["species"] == "bird"
    wanted = spark.createDataFrame([("uuid-0001",), ("uuid-0001",), ("none",)], "id string")
    assert records.lookup_many(mixed, "uuid", wanted).count() == 1


def test_record_detail_formats(mixed):
    detail = records.record_detail(records.lookup(mixed.withColumn("tags", F.array(F.lit(1))), "uuid", "uuid-0001"), "uuid")
    assert values(detail, "Field", "Value") == [
        ("family", "canidae"), ("notes", "large breed"), ("species", "dog"), ("tags", "[1 items]"), ("weight", "25.0000"),
    ]


def test_image_url_order_and_scheme(spark):
    rows = [("x", "https://b", "https://c"), ("http://a", "https://b", None), ("HTTP://a", None, "https://c"), (None, None, "c")]
    df = spark.createDataFrame(rows, "identifier string, url string, image string")
    assert [r["resolved_url"] for r in records.with_image_url(df).collect()] == ["https://b", "http://a", "https://c", None]
    assert records.with_image_url(spark.range(1)).first()["resolved_url"] is None


def test_tooltip_columns():
    columns = ["x", "y", "uuid", "species", "url", "file_name"] + [f"c{i}" for i in range(20)]
    assert records.tooltip_columns(columns)[:2] == ["species", "file_name"]
    assert len(records.tooltip_columns(columns, "c3")) == 16
    assert records.tooltip_columns(columns, "c3", file_names=True)[:3] == ["file_name", "c3", "species"]


def test_label_columns_in_numeric_order():
    assert profile.label_columns(["KMeans (k=12)", "a", "KMeans (k=3)"]) == ["KMeans (k=3)", "KMeans (k=12)"]


def test_legend_order(spark):
    def legend(items):
        df = spark.createDataFrame([(i,) for i in items], "c string")
        return [v for _, v in sorted(tuple(r) for r in profile.legend_order(df, "c").collect())]

    assert legend(["10", "9", "-1", "9"]) == ["-1", "9", "10"]
    assert legend(["10", "9", "N/A"]) == ["10", "9", "N/A"]


@pytest.mark.parametrize(
    "low, high, maxbins, start, step",
    [(0, 100, 40, 0, 5), (1, 50, 10, 0, 5), (900, 104000, 80, 0, 2000), (3, 3, 40, 3, 0.1)],
)
def test_nice_bins(low, high, maxbins, start, step):
    bins = nice_bins(low, high, maxbins)
    assert (bins.start, bins.step) == pytest.approx((start, step))
    assert bins.start <= low and bins.stop >= high


def test_density_grid_counts_every_point(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (100.0, 100.0), (99.9, 99.9), (float("nan"), 1.0), (None, 1.0), (float("inf"), 0.0)], "x double, y double"
    )
    assert values(density.density_grid(df), "x_bin", "y_bin", "n") == [(0, 0, 1), (19, 19, 2)]
    same = spark.createDataFrame([(2.0, 2.0)] * 3, "x double, y double")
    assert [r["n"] for r in density.density_grid(same).collect()] == [3]
    assert density.density_grid(df.filter("false")).count() == 0
