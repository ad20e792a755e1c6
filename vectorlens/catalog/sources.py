"""Loading, splitting, writing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.functions.predicates import apply_membership_filters
from vectorlens.session import fresh_path
from vectorlens.sources import images, sinks, tables

BATCH_FILTERS = {
    "_description": "membership only",
    "o_orderpriority": ["1-URGENT", "5-LOW"],
    "o_orderstatus": ["F", "O"],
    "o_custkey": [],
}


def load_stats(spark, sf):
    return tables.load_statistics(table(spark, sf, "embeddings"), "embedding")


def batch_load_filtered(spark, sf):
    kept = apply_membership_filters(table(spark, sf, "orders"), BATCH_FILTERS)
    return kept.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def metadata_split(spark, sf):
    return tables.metadata_only(table(spark, sf, "embeddings"), "embedding")


def vector_long(spark, sf):
    long = tables.vector_elements(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return long.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def union_parts(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
    )
    return tables.union_parts([customer, supplier])


def listed_files(spark, sf):
    """Texts written as one file per source: a deep listing finds them, a flat one only the empty marker beside them."""
    path = fresh_path(spark, "listed")
    texts = table(spark, sf, "documents").select("source", "text")
    texts.repartition("source").write.option("maxRecordsPerFile", 0).partitionBy("source").text(path)
    deep = images.list_files(spark, path, (".txt",), recursive=True).withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    flat = images.list_files(spark, path, (".txt", "_success")).select(F.lit("").alias("source"), "length")
    found = deep.select("source", "length").unionByName(flat)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") == 0).alias("empty"))


def loaded_checked(spark, sf):
    """A table loaded with its checks in the plan of the first job."""
    rows = tables.load_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", {"label": [1, 2, 3]})
    return rows.select("vec_id", "label", F.size("embedding").alias("width"))


def labelled_dataset(spark, sf):
    frame = table(spark, sf, "embeddings").select(
        "vec_id",
        "embedding",
        F.round(F.col("embedding")[0].cast("double"), 6).alias("dim_1"),
        F.round(F.col("embedding")[1].cast("double"), 6).alias("dim_2"),
        F.col("label").cast("string").alias("cluster_label"),
    )
    path = sinks.write_labelled(tables.metadata_only(frame, "embedding"), fresh_path(spark, "labelled"))
    return spark.read.parquet(path)


def _paths(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("url").alias("image_path"), F.pmod("page_id", F.lit(5)).cast("string").alias("cluster")
    )


def repartition_manifest(spark, sf):
    return sinks.cluster_manifest(_paths(spark, sf), "/export")


def save_manifest(spark, sf):
    return sinks.selected_manifest(_paths(spark, sf), ["1", "4"], "/export")


def _markup_encoder():
    def encode(contents):
        return [
            np.array([len(c), c.count(b"<"), c.count(b"&"), c.count(b" ")]) if c is not None else None
            for c in contents
        ]

    return encode


def embed_contents(spark, sf):
    embedded = images.embed_contents(table(spark, sf, "pages"), _markup_encoder, "page_id", "html")
    names = ["n_bytes", "n_tags", "n_entities", "n_spaces"]
    return embedded.select("page_id", *[F.col("emb")[i].cast("long").alias(n) for i, n in enumerate(names)])


_MANIFEST = """
WITH r AS (
  SELECT url AS source, regexp_extract(url, '[^/]*$') AS file_name, CAST(page_id % 5 AS VARCHAR) AS cluster FROM pages
)
SELECT source, '/export/cluster_' || cluster || '/' || file_name AS abs_path, file_name, cluster,
       count(*) OVER (PARTITION BY cluster, file_name) > 1 AS collides
FROM r
"""

QUERIES = {
    "listed_files": (
        listed_files,
        """
        SELECT source, count(DISTINCT source) AS files, 0::BIGINT AS empty FROM documents GROUP BY source
        UNION ALL SELECT '', 1, 1
        """,
    ),
    "loaded_checked": (
        loaded_checked,
        "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE label IN (1, 2, 3)",
    ),
    "load_stats": (
        load_stats,
        """
        SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_missing,
               CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max
        FROM embeddings
        """,
    ),
    "batch_load_filtered": (
        batch_load_filtered,
        """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O')
        """,
    ),
    "metadata_split": (metadata_split, "SELECT vec_id, label FROM embeddings"),
    "vector_long": (
        vector_long,
        """
        SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
               round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value
        FROM embeddings
        """,
    ),
    "union_parts": (
        union_parts,
        """
        SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
        FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
        """,
    ),
    "labelled_dataset": (
        labelled_dataset,
        """
        SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS dim_1,
               round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS dim_2, CAST(label AS VARCHAR) AS cluster_label
        FROM embeddings
        """,
    ),
    "repartition_manifest": (repartition_manifest, _MANIFEST),
    "save_manifest": (save_manifest, _MANIFEST + " WHERE cluster IN ('1', '4')"),
    "embed_contents": (
        embed_contents,
        """
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes,
               CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS n_tags,
               CAST(length(html) - length(replace(html, '&', '')) AS BIGINT) AS n_entities,
               CAST(length(html) - length(replace(html, ' ', '')) AS BIGINT) AS n_spaces
        FROM pages
        """,
    ),
}
