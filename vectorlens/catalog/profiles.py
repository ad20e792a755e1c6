"""Column profiles and the orderings derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import profile


def _documents(spark, sf):
    """Documents with one column of each further class: all null, boolean, categories with nulls, and a list."""
    return table(spark, sf, "documents").select(
        "*",
        F.lit(None).cast("string").alias("nothing"),
        (F.col("n_chars") > 1000).alias("is_long"),
        F.nullif("lang", F.lit("es")).alias("lang_or_null"),
        F.array("n_chars").alias("as_list"),
    )


def _customer(spark, sf):
    """Exactly 100 distinct values, and the same with null as the hundred-and-first."""
    code = F.pmod("c_custkey", F.lit(101)).cast("string")
    return table(spark, sf, "customer").select(
        "*",
        F.pmod("c_custkey", F.lit(100)).cast("string").alias("hundred"),
        code.alias("hundred_one"),
        F.nullif(code, F.lit("7")).alias("hundred_and_null"),
        F.nullif(F.pmod("c_custkey", F.lit(100)).cast("string"), F.lit("7")).alias("ninety_nine_and_null"),
    )


def _rounded(df):
    return df.withColumn("null_pct", F.round("null_pct", 6))


def profile_documents(spark, sf):
    return _rounded(profile.profile(_documents(spark, sf)))


def profile_events(spark, sf):
    return _rounded(profile.profile(table(spark, sf, "events")))


def profile_orders(spark, sf):
    return _rounded(profile.profile(table(spark, sf, "orders")))


def profile_customer(spark, sf):
    return _rounded(profile.profile(_customer(spark, sf)))


def profile_embeddings(spark, sf):
    return _rounded(profile.profile(table(spark, sf, "embeddings")))


def class_counts(spark, sf):
    return profile.class_counts(_documents(spark, sf))


def value_counts(spark, sf):
    return profile.value_counts(_documents(spark, sf))


def value_counts_events(spark, sf):
    return profile.value_counts(table(spark, sf, "events"))


def column_summary(spark, sf):
    return profile.column_summary(_documents(spark, sf))


def filter_columns_order(spark, sf):
    return profile.filter_column_order(_documents(spark, sf))


def k_from_column(spark, sf):
    return profile.clusters_from_column(table(spark, sf, "documents"), "source", {"lang": ["de", "fr"]})


def color_candidates(spark, sf):
    frame = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("x"),
        F.col("o_orderkey").cast("double").alias("y"),
        F.col("o_orderkey").alias("uuid"),
        "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.lit(float("nan")))
        .otherwise(F.pmod("o_custkey", F.lit(30)).cast("double"))
        .alias("score"),
        "o_custkey",
        F.pmod("o_orderkey", F.lit(12)).cast("string").alias("KMeans (k=12)"),
        F.pmod("o_orderkey", F.lit(3)).cast("string").alias("KMeans (k=3)"),
    )
    return profile.colour_candidates(frame)


def legend_numeric(spark, sf):
    return profile.legend_order(table(spark, sf, "conversations"), "turn")


def legend_text(spark, sf):
    return profile.legend_order(table(spark, sf, "documents"), "source")


def _facts(source: str, columns: list[tuple[int, str, str, str]]) -> str:
    """Profile in SQL: ``(position, name, class when not counted or 'count', expression)``."""
    rows = []
    for position, name, kind, expression in columns:
        distinct = f"count(DISTINCT {expression})"
        category = f"{distinct} + (count(*) > count({expression}))::INT <= 100"
        if kind == "count":
            shown, unique = f"CASE WHEN {category} THEN 'categorical' ELSE 'text' END", f"CASE WHEN {category} THEN {distinct} END"
        else:
            shown, unique = f"'{kind}'", "0" if kind == "empty" else "NULL"
        rows.append(
            f"SELECT CAST({position} AS INTEGER) AS position, '{name}' AS \"column\", {shown} AS type, "
            f"CAST({unique} AS BIGINT) AS n_unique, count(*) - count({expression}) AS null_count, "
            f"count(*) AS total_count, "
            f"round(CAST((count(*) - count({expression})) * 100.0 AS DOUBLE) / count(*), 6) AS null_pct FROM {source}"
        )
    return " UNION ALL ".join(rows)


_DOCUMENT_FACTS = _facts(
    "documents",
    [
        (0, "doc_id", "numeric", "doc_id"),
        (1, "text", "count", "text"),
        (2, "lang", "count", "lang"),
        (3, "source", "count", "source"),
        (4, "n_chars", "numeric", "n_chars"),
        (5, "nothing", "empty", "CAST(NULL AS VARCHAR)"),
        (6, "is_long", "count", "(n_chars > 1000)"),
        (7, "lang_or_null", "count", "nullif(lang, 'es')"),
    ],
)

def label_columns_order(spark, sf):
    """Label columns by their number, not as text, with the clusters in each."""
    rows = table(spark, sf, "embeddings")
    names = ["KMeans (k=12)", "KMeans (k=x)", "KMeans (k=3)", "other", "KMeans (k=100)"]
    rows = rows.select(*[F.pmod("vec_id", F.lit(m)).cast("string").alias(n) for n, m in zip(names, (12, 5, 3, 7, 100), strict=True)])
    ordered = profile.label_columns(rows.columns)
    counts = rows.agg(*[F.countDistinct(F.col(f"`{n}`")).alias(n) for n in ordered])
    pairs = [x for i, n in enumerate(ordered) for x in (F.lit(i), F.lit(n), F.col(f"`{n}`"))]
    return counts.select(F.stack(F.lit(len(ordered)), *pairs).alias("place", "name", "clusters"))


QUERIES = {
    "label_columns_order": (
        label_columns_order,
        """
        SELECT 0 AS place, 'KMeans (k=3)' AS name, count(DISTINCT vec_id % 3) AS clusters FROM embeddings
        UNION ALL SELECT 1, 'KMeans (k=12)', count(DISTINCT vec_id % 12) FROM embeddings
        UNION ALL SELECT 2, 'KMeans (k=100)', count(DISTINCT vec_id % 100) FROM embeddings
        """,
    ),
    "profile_documents": (profile_documents, _DOCUMENT_FACTS),
    "profile_events": (
        profile_events,
        _facts(
            "events",
            [
                (0, "event_id", "numeric", "event_id"),
                (1, "ts", "count", "ts"),
                (2, "user_id", "numeric", "user_id"),
                (3, "event_type", "count", "event_type"),
                (4, "value", "numeric", "value"),
                (5, "props", "count", "props"),
            ],
        ),
    ),
    "profile_orders": (
        profile_orders,
        _facts(
            "orders",
            [
                (0, "o_orderkey", "numeric", "o_orderkey"),
                (1, "o_custkey", "numeric", "o_custkey"),
                (2, "o_orderstatus", "count", "o_orderstatus"),
                (3, "o_totalprice", "numeric", "o_totalprice"),
                (4, "o_orderdate", "count", "o_orderdate"),
                (5, "o_orderpriority", "count", "o_orderpriority"),
            ],
        ),
    ),
    "profile_customer": (
        profile_customer,
        _facts(
            "customer",
            [
                (0, "c_custkey", "numeric", "c_custkey"),
                (1, "c_name", "count", "c_name"),
                (2, "c_nationkey", "numeric", "c_nationkey"),
                (3, "c_acctbal", "numeric", "c_acctbal"),
                (4, "c_mktsegment", "count", "c_mktsegment"),
                (5, "hundred", "count", "(c_custkey % 100)"),
                (6, "hundred_one", "count", "(c_custkey % 101)"),
                (7, "hundred_and_null", "count", "nullif(c_custkey % 101, 7)"),
                (8, "ninety_nine_and_null", "count", "nullif(c_custkey % 100, 7)"),
            ],
        ),
    ),
    "profile_embeddings": (
        profile_embeddings,
        _facts("embeddings", [(0, "vec_id", "numeric", "vec_id"), (1, "label", "numeric", "label")]),
    ),
    "class_counts": (class_counts, f"SELECT type, count(*) AS n FROM ({_DOCUMENT_FACTS}) GROUP BY type"),
    "value_counts": (
        value_counts,
        """
        SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
        UNION ALL SELECT 'is_long', CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END, count(*) FROM documents GROUP BY 2
        UNION ALL SELECT 'lang_or_null', lang, count(*) FROM documents WHERE lang <> 'es' GROUP BY lang
        """,
    ),
    "value_counts_events": (
        value_counts_events,
        """
        SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY event_type
        UNION ALL SELECT 'props', props, count(*) FROM events
          WHERE (SELECT count(DISTINCT props) FROM events) <= 100 GROUP BY props
        """,
    ),
    "column_summary": (
        column_summary,
        f"""
        SELECT "column" AS "Column", type AS "Type",
               CASE WHEN n_unique > 0 THEN CAST(n_unique AS VARCHAR) ELSE 'many' END AS "Unique",
               round(null_pct, 1) AS null_pct
        FROM ({_DOCUMENT_FACTS})
        """,
    ),
    "filter_columns_order": (
        filter_columns_order,
        f"""
        WITH r AS (
          SELECT *, CAST(CASE type WHEN 'categorical' THEN 0 WHEN 'numeric' THEN 1 WHEN 'text' THEN 2 END AS INTEGER)
                    AS type_rank
          FROM ({_DOCUMENT_FACTS})
        )
        SELECT CAST(row_number() OVER (
                 ORDER BY type_rank, CASE WHEN type_rank = 0 THEN n_unique ELSE 0 END, position) AS INTEGER) AS rank,
               "column", type_rank
        FROM r WHERE type_rank IS NOT NULL
        """,
    ),
    "k_from_column": (
        k_from_column,
        """
        SELECT count(DISTINCT source) AS n_clusters, CAST(2 AS INTEGER) AS slider_min,
               CAST(least(100, count(*) // 2) AS BIGINT) AS slider_max
        FROM documents WHERE lang IN ('de', 'fr')
        """,
    ),
    "color_candidates": (
        color_candidates,
        """
        WITH c AS (
          SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS n_unique, 3 AS position FROM orders
          UNION ALL SELECT 'status', count(DISTINCT CASE o_orderstatus WHEN 'P' THEN 'N/A' ELSE o_orderstatus END), 4 FROM orders
          UNION ALL SELECT 'score', count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE o_custkey % 30 END), 5 FROM orders
          UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 6 FROM orders
          UNION ALL SELECT 'KMeans (k=12)', count(DISTINCT o_orderkey % 12), 2 FROM orders
          UNION ALL SELECT 'KMeans (k=3)', count(DISTINCT o_orderkey % 3), 1 FROM orders
        )
        SELECT "column", n_unique, CAST(position AS BIGINT) AS position, n_unique > 20 AS many FROM c WHERE n_unique <= 100
        """,
    ),
    "legend_numeric": (
        legend_numeric,
        """
        SELECT row_number() OVER (ORDER BY turn) AS rank, CAST(turn AS VARCHAR) AS value
        FROM (SELECT DISTINCT turn FROM conversations)
        """,
    ),
    "legend_text": (
        legend_text,
        """
        SELECT row_number() OVER (ORDER BY source) AS rank, source AS value
        FROM (SELECT DISTINCT source FROM documents)
        """,
    ),
}
