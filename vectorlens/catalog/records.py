"""Row-level views and the density grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import density, records
from vectorlens.operators.ordering import with_row_index


def plot_frame(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("uuid"),
        "p_retailprice",
        "p_size",
        F.nullif("p_brand", F.lit("Brand#1")).alias("brand"),
        F.when(F.col("p_size") > 45, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price"),
        F.array("p_size").alias("vector"),
        F.col("p_type").alias("idx"),
    )
    return records.plot_frame(part, "p_retailprice", "p_size")


def row_index(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return with_row_index(documents, [F.col("doc_id")]).withColumn("idx", F.col("idx").cast("long"))


def basename(spark, sf):
    return records.with_file_name(table(spark, sf, "pages").select("page_id", "url"), "url")


def record_lookup(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return records.lookup_many(documents, "doc_id", table(spark, sf, "labels").select("doc_id"))


def record_detail(spark, sf):
    part = table(spark, sf, "part").withColumn("p_name", F.nullif("p_name", F.lit("small ring")))
    return records.record_detail(part.withColumn("sizes", F.array("p_size", "p_size")), "p_partkey")


def image_url(spark, sf):
    candidates = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.col("url"), F.lit("#id"))).otherwise("local").alias("identifier"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, F.upper("url")).alias("image_url"),
        F.when(F.pmod("page_id", F.lit(5)) != 0, F.col("url")).alias("url"),
    )
    return records.with_image_url(candidates).select("page_id", "resolved_url")


def density_grid(spark, sf):
    return density.density_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 40)


def density_grid_fine(spark, sf):
    return density.density_grid(table(spark, sf, "orders"), "o_totalprice", "o_custkey", 80)


def _axis(name: str, column: str, source: str, maxbins: int) -> str:
    """The bin rule as a chain of CTEs: span, power of ten, refinement by 5 and 2, start and stop."""
    return f"""
      {name}0 AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}),
      {name}1 AS (SELECT *, CASE WHEN hi > lo THEN hi - lo WHEN lo <> 0 THEN abs(lo) ELSE 1 END AS span FROM {name}0),
      {name}2 AS (SELECT *, pow(10, floor(log10(span) + 0.5) - ceil(log10({maxbins}))) AS s FROM {name}1),
      {name}3 AS (SELECT lo, hi, span, CASE WHEN ceil(span / s) <= {maxbins} THEN s
                         WHEN ceil(span / (s * 10)) <= {maxbins} THEN s * 10 ELSE s * 100 END AS s FROM {name}2),
      {name}4 AS (SELECT lo, hi, span, CASE WHEN span / (s / 5) <= {maxbins} THEN s / 5 ELSE s END AS s FROM {name}3),
      {name}5 AS (SELECT lo, hi, CASE WHEN span / (s / 2) <= {maxbins} THEN s / 2 ELSE s END AS step FROM {name}4),
      {name}6 AS (SELECT *, floor(lo / step + pow(10, -(CASE WHEN step >= 1 THEN 0
                         ELSE CAST(trunc(-log10(step)) AS INTEGER) + 1 END) - 1)) * step AS v FROM {name}5),
      {name} AS (SELECT step, CASE WHEN lo < v THEN v - step ELSE v END AS start, ceil(hi / step) * step AS stop FROM {name}6)
    """


def _grid(source: str, x: str, y: str, maxbins: int) -> str:
    return f"""
    WITH {_axis("ax", x, source, maxbins)}, {_axis("ay", y, source, maxbins)},
    b AS (
      SELECT CAST(floor((least({x}::DOUBLE, ax.stop - ax.step) - ax.start) / ax.step + 1e-14) AS BIGINT) AS x_bin,
             CAST(floor((least({y}::DOUBLE, ay.stop - ay.step) - ay.start) / ay.step + 1e-14) AS BIGINT) AS y_bin
      FROM {source}, ax, ay
    )
    SELECT x_bin, y_bin, any_value(ax.start + x_bin * ax.step) AS x_start,
           any_value(ay.start + y_bin * ay.step) AS y_start, count(*) AS n
    FROM b, ax, ay GROUP BY x_bin, y_bin
    """


def record_first(spark, sf):
    """The first of several records with one id."""
    return records.lookup(table(spark, sf, "lineitem"), "l_orderkey", 1)


def tooltip_fields(spark, sf):
    """What a tooltip shows: the colour column, then other metadata in table order, without ids and vectors."""
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "uuid")
    return rows.select("uuid", *[F.col(c) for c in records.tooltip_columns(rows.columns, "c_mktsegment", limit=2)])


QUERIES = {
    "record_first": (record_first, "SELECT * FROM lineitem WHERE l_orderkey = 1 ORDER BY ALL LIMIT 1"),
    "tooltip_fields": (tooltip_fields, "SELECT c_custkey AS uuid, c_mktsegment, c_name, c_nationkey FROM customer"),
    "plot_frame": (
        plot_frame,
        """
        SELECT p_retailprice AS x, p_size AS y, p_partkey AS uuid, coalesce(nullif(p_brand, 'Brand#1'), 'N/A') AS brand,
               CASE WHEN p_size <= 45 THEN p_retailprice END AS price
        FROM part
        """,
    ),
    "row_index": (row_index, "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents"),
    "basename": (basename, "SELECT page_id, url, regexp_extract(url, '[^/]*$') AS file_name FROM pages"),
    "record_lookup": (
        record_lookup,
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
    "record_detail": (
        record_detail,
        """
        SELECT p_partkey, 'p_name' AS "Field", p_name AS "Value" FROM part WHERE p_name <> 'small ring'
        UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
        UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
        UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'p_retailprice', printf('%.4f', p_retailprice) FROM part
        UNION ALL SELECT p_partkey, 'sizes', '[2 items]' FROM part
        """,
    ),
    "image_url": (
        image_url,
        """
        SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '#id' WHEN page_id % 5 <> 0 THEN url END AS resolved_url
        FROM pages
        """,
    ),
    "density_grid": (density_grid, _grid("lineitem", "l_quantity", "l_extendedprice", 40)),
    "density_grid_fine": (density_grid_fine, _grid("orders", "o_totalprice", "o_custkey", 80)),
}
