"""Conjunctive filters and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.functions.predicates import apply_filters
from vectorlens.operators import cascade

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
DOCUMENT_COLUMNS = ["doc_id", "lang", "source", "n_chars"]


def filter_categorical(spark, sf):
    filters = {"o_orderpriority": ["1-URGENT", "3-MEDIUM"], "o_orderstatus": [], "absent": ["x"], "o_custkey": None}
    return apply_filters(table(spark, sf, "orders"), filters).select(*ORDER_COLUMNS)


def filter_range(spark, sf):
    filters = {"o_totalprice": {"min": 100000.0, "max": 250000.0}, "o_custkey": {"min": None, "max": 900}}
    return apply_filters(table(spark, sf, "orders"), filters).select(*ORDER_COLUMNS)


def filter_text(spark, sf):
    return apply_filters(table(spark, sf, "documents"), {"text": "The "}).select(*DOCUMENT_COLUMNS)


def filter_combined(spark, sf):
    filters = {"lang": ["en", "fr"], "n_chars": {"min": 200}, "text": "ON", "source": "  "}
    return apply_filters(table(spark, sf, "documents"), filters).select(*DOCUMENT_COLUMNS)


def _orders_without_urgent(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")
    )


def filter_null_in_list(spark, sf):
    return apply_filters(_orders_without_urgent(spark, sf), {"priority": [None, "5-LOW"]})


def _events_with_nan(spark, sf):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(
        F.col("event_type") != "signup", F.col("value")
    )
    return table(spark, sf, "events").select("event_id", "event_type", value.alias("value"))


def filter_nan_range(spark, sf):
    return apply_filters(_events_with_nan(spark, sf), {"value": {"min": 5.0}})


CASCADE = {"lang": ["en", "de"], "n_chars": {"min": 100, "max": 5000}, "text": "an"}


def cascade_options(spark, sf):
    return cascade.options(table(spark, sf, "documents"), "source", CASCADE)


def cascade_unfiltered(spark, sf):
    return cascade.options(table(spark, sf, "documents"), "source", {"source": ["src1"]})


def cascade_all(spark, sf):
    filters = {"lang": ["en", "de"], "source": ["src1", "src2", "src3"], "n_chars": {"min": 100, "max": 5000}}
    return cascade.options_for_all(table(spark, sf, "documents"), ["lang", "source", "n_chars"], filters)


def cascade_range(spark, sf):
    filters = {"event_type": ["view", "click", "error"], "value": {"min": -1.0, "max": 50.0}}
    return cascade.numeric_range(_events_with_nan(spark, sf), "value", filters)


def prune_selection(spark, sf):
    filters = {"source": ["src3", "gone", "src1"], "lang": ["fr"]}
    return cascade.prune_selection(table(spark, sf, "documents"), "source", filters)


def preview_retention(spark, sf):
    shown = cascade.preview(table(spark, sf, "documents"), CASCADE)
    return shown.withColumn("retained_pct", F.round("retained_pct", 6))


def text_search_columns(spark, sf):
    """Which columns of a table can be searched as text, and how many rows a search keeps."""
    rows = table(spark, sf, "customer")
    facts = []
    for column in rows.columns:
        try:
            found = apply_filters(rows, {column: "A"}).count()
        except TypeError:
            found = None
        facts.append((column, found is None, found))
    return spark.createDataFrame(facts, "name string, refused boolean, hits long")


QUERIES = {
    "text_search_columns": (
        text_search_columns,
        """
        SELECT 'c_name' AS name, false AS refused, count(*) AS hits FROM customer WHERE lower(c_name) LIKE '%a%'
        UNION ALL SELECT 'c_mktsegment', false, count(*) FROM customer WHERE lower(c_mktsegment) LIKE '%a%'
        UNION ALL SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']), true, NULL
        """,
    ),
    "filter_categorical": (
        filter_categorical,
        f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')",
    ),
    "filter_range": (
        filter_range,
        f"""
        SELECT {', '.join(ORDER_COLUMNS)} FROM orders
        WHERE o_totalprice BETWEEN 100000 AND 250000 AND o_custkey <= 900
        """,
    ),
    "filter_text": (
        filter_text,
        f"SELECT {', '.join(DOCUMENT_COLUMNS)} FROM documents WHERE contains(lower(text), 'the ')",
    ),
    "filter_combined": (
        filter_combined,
        f"""
        SELECT {', '.join(DOCUMENT_COLUMNS)} FROM documents
        WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND contains(lower(text), 'on')
        """,
    ),
    "filter_null_in_list": (
        filter_null_in_list,
        """
        SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders
        WHERE nullif(o_orderpriority, '1-URGENT') IS NULL OR o_orderpriority = '5-LOW'
        """,
    ),
    "filter_nan_range": (
        filter_nan_range,
        """
        SELECT event_id, event_type, value FROM events
        WHERE event_type NOT IN ('error', 'signup') AND value >= 5
        """,
    ),
    "cascade_options": (
        cascade_options,
        """
        SELECT DISTINCT source AS value FROM documents
        WHERE lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000 AND contains(lower(text), 'an')
        """,
    ),
    "cascade_unfiltered": (cascade_unfiltered, "SELECT DISTINCT source AS value FROM documents"),
    "cascade_all": (
        cascade_all,
        """
        WITH d AS (
          SELECT *, lang IN ('en', 'de') AS p1, source IN ('src1', 'src2', 'src3') AS p2,
                 n_chars BETWEEN 100 AND 5000 AS p3 FROM documents
        )
        SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM d WHERE p2 AND p3 GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM d WHERE p1 AND p3 GROUP BY source
        UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), count(*) FROM d WHERE p1 AND p2 GROUP BY n_chars
        """,
    ),
    "cascade_range": (
        cascade_range,
        """
        WITH b AS (
          SELECT min(value) AS low, max(value) AS high FROM events WHERE event_type IN ('view', 'click')
        ), c AS (
          SELECT low, high, greatest(low, least(CAST(-1.0 AS DOUBLE), high)) AS min,
                 greatest(low, least(CAST(50.0 AS DOUBLE), high)) AS max FROM b
        )
        SELECT low, high, min, max, low <> high AS offered,
               low <> high AND (min <> low OR max <> high) AS active FROM c
        """,
    ),
    "prune_selection": (
        prune_selection,
        """
        SELECT DISTINCT CAST(list_position(['src3', 'gone', 'src1'], source) AS BIGINT) AS position, source AS value
        FROM documents WHERE lang = 'fr' AND source IN ('src3', 'gone', 'src1')
        """,
    ),
    "preview_retention": (
        preview_retention,
        """
        WITH d AS (
          SELECT lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000 AND contains(lower(text), 'an') AS hit
          FROM documents
        )
        SELECT count(*) FILTER (hit) AS kept, count(*) AS total,
               round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 6) AS retained_pct FROM d
        """,
    ),
}
