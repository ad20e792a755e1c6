"""Agreement of clusters with metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import evaluation


def _embeddings(spark, sf):
    """Given labels against a category with missing values."""
    group = F.pmod("vec_id", F.lit(7))
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("cluster"),
        F.when(group != 3, F.concat(F.lit("g"), group.cast("string"))).alias("kind"),
    )


def _documents(spark, sf):
    """Language as the cluster, the quality label as the category; unlabelled documents have none."""
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left").select(F.col("lang").alias("cluster"), F.col("quality").alias("kind"))


def contingency(spark, sf):
    return evaluation.contingency(_embeddings(spark, sf), "cluster", "kind")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def agreement(spark, sf):
    return _rounded(evaluation.agreement(_embeddings(spark, sf), "cluster", "kind"), "ari", "nmi")


def agreement_documents(spark, sf):
    return _rounded(evaluation.agreement(_documents(spark, sf), "cluster", "kind"), "ari", "nmi")


def agreement_identical(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.substring("o_orderpriority", 1, 1).alias("cluster")
    )
    return _rounded(evaluation.agreement(orders, "cluster", "kind"), "ari", "nmi")


def eval_counts(spark, sf):
    return evaluation.row_counts(_documents(spark, sf), "kind")


def purity_entropy(spark, sf):
    return _rounded(evaluation.purity_entropy(_documents(spark, sf), "cluster", "kind"), "purity", "entropy")


def composition(spark, sf):
    return _rounded(evaluation.composition(_embeddings(spark, sf), "cluster", "kind").drop("is_last"), "pct")


def composition_tree(spark, sf):
    return evaluation.composition_tree(_embeddings(spark, sf), "cluster", "kind")


_EMBEDDINGS = """
t AS (SELECT CAST(label AS VARCHAR) AS cluster,
             CASE WHEN vec_id % 7 <> 3 THEN 'g' || CAST(vec_id % 7 AS VARCHAR) ELSE 'N/A' END AS category FROM embeddings)
"""
_DOCUMENTS = """
t AS (SELECT lang AS cluster, coalesce(CAST(quality AS VARCHAR), 'N/A') AS category
      FROM documents LEFT JOIN labels USING (doc_id))
"""
_ORDERS = "t AS (SELECT substr(o_orderpriority, 1, 1) AS cluster, o_orderpriority AS category FROM orders)"


def _agreement(source: str) -> str:
    return f"""
    WITH {source},
    cells AS (SELECT cluster, category, count(*)::DOUBLE AS n FROM t WHERE category <> 'N/A' GROUP BY ALL),
    a AS (SELECT cluster, sum(n) AS a FROM cells GROUP BY cluster),
    b AS (SELECT category, sum(n) AS b FROM cells GROUP BY category),
    tot AS (SELECT sum(n) AS total FROM cells),
    sums AS (SELECT (SELECT total FROM tot) AS n, (SELECT sum(n * n) FROM cells) AS s,
                    (SELECT sum(a * a) FROM a) AS sa, (SELECT sum(b * b) FROM b) AS sb,
                    (SELECT -sum(a / total * ln(a / total)) FROM a, tot) AS ha,
                    (SELECT -sum(b / total * ln(b / total)) FROM b, tot) AS hb,
                    (SELECT sum(n / total * ln(total * n / (a * b))) FROM cells JOIN a USING (cluster)
                       JOIN b USING (category), tot) AS mi),
    pairs AS (SELECT *, s - n AS tp, sb - s AS fp, sa - s AS fn, n * n - (sb - s) - (sa - s) - s AS tn FROM sums)
    SELECT (SELECT count(*) FROM t WHERE category <> 'N/A') AS evaluated,
           (SELECT count(*) FROM t WHERE category = 'N/A') AS excluded,
           round(CASE WHEN fp = 0 AND fn = 0 THEN 1.0::DOUBLE
                 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 6) AS ari,
           round(mi / ((ha + hb) / 2), 6) AS nmi
    FROM pairs
    """


_CELLS = "cells AS (SELECT cluster, category, count(*) AS n FROM t GROUP BY ALL)"

def agreement_nothing(spark, sf):
    """No row has a known category: counts, and no metrics."""
    rows = table(spark, sf, "documents").select("source", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("N/A")).alias("category"))
    return evaluation.agreement(rows, "source", "category")


QUERIES = {
    "agreement_nothing": (
        agreement_nothing,
        "SELECT 0::BIGINT AS evaluated, count(*) AS excluded, NULL::DOUBLE AS ari, NULL::DOUBLE AS nmi FROM documents",
    ),
    "contingency": (contingency, f"WITH {_EMBEDDINGS}, {_CELLS} SELECT * FROM cells"),
    "agreement": (agreement, _agreement(_EMBEDDINGS)),
    "agreement_documents": (agreement_documents, _agreement(_DOCUMENTS)),
    "agreement_identical": (agreement_identical, _agreement(_ORDERS)),
    "eval_counts": (
        eval_counts,
        f"""
        WITH {_DOCUMENTS}
        SELECT count(*) FILTER (category <> 'N/A') AS evaluated, count(*) FILTER (category = 'N/A') AS excluded FROM t
        """,
    ),
    "purity_entropy": (
        purity_entropy,
        f"""
        WITH {_DOCUMENTS}, {_CELLS},
        p AS (SELECT cluster, n, n / (sum(n) OVER (PARTITION BY cluster))::DOUBLE AS p FROM cells)
        SELECT cluster, CAST(sum(n) AS BIGINT) AS n, round(max(p), 6) AS purity, round(-sum(p * log2(p)), 6) AS entropy
        FROM p GROUP BY cluster
        """,
    ),
    "composition": (
        composition,
        f"""
        WITH {_EMBEDDINGS}, {_CELLS}
        SELECT cluster, category, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cluster), 6) AS pct,
               CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS INTEGER) AS rank
        FROM cells
        """,
    ),
    "composition_tree": (
        composition_tree,
        f"""
        WITH {_EMBEDDINGS}, {_CELLS},
        totals AS (
          SELECT cluster, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, CAST(cluster AS BIGINT) AS number FROM cells GROUP BY cluster
        ),
        r AS (
          SELECT *, n::DOUBLE / total AS p, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS place,
                 count(*) OVER (PARTITION BY cluster) AS size, number = (SELECT max(number) FROM totals) AS last
          FROM cells JOIN totals USING (cluster)
        ),
        heads AS (
          SELECT number, 0 AS place, CASE WHEN any_value(last) THEN '└── ' ELSE '├── ' END || printf(
                   'Cluster %s  [%d pts]  purity: %.0f%%  entropy: %.2f', any_value(cluster), any_value(total),
                   max(p) * 100, log2(any_value(total)) - sum(n * log2(n)) / any_value(total)) AS line
          FROM r GROUP BY number
        ),
        entries AS (
          SELECT number, place, CASE WHEN last THEN '    ' ELSE '│   ' END || CASE WHEN place = size THEN '└─ ' ELSE '├─ ' END
                 || printf('%-20s %4d  %5.1f%%', category, n, p * 100) AS line FROM r
        ),
        title AS (
          SELECT -3 AS number, 0 AS place, printf('KMeans Clustering Summary (%d points, %d clusters)', CAST(sum(total) AS BIGINT), count(*)) AS line FROM totals
          UNION ALL SELECT -2, 0, 'Compared against: kind' UNION ALL SELECT -1, 0, ''
        )
        SELECT row_number() OVER (ORDER BY number, place) - 1 AS line_no, line
        FROM (SELECT * FROM title UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM entries)
        """,
    ),
}
