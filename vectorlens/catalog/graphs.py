"""Neighbour graph, neighbour weights, neighbour layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import descent, layout, neighbours, projection
from vectorlens.operators.ordering import with_row_key
from vectorlens.session import cut_lineage


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def _rounded(graph):
    return graph.withColumn("dist", F.round("dist", 6))


def knn_graph(spark, sf):
    return _rounded(neighbours.knn_graph(_embeddings(spark, sf), 15, "vec_id", "embedding"))


def knn_graph_blocks(spark, sf):
    """The same graph through small cells and blocks, as a large table would take it."""
    return _rounded(neighbours.knn_graph(_embeddings(spark, sf), 15, "vec_id", "embedding", block_rows=128))


def _with_copies(spark, sf):
    """Every third vector replaced by the first one of its label: many exact copies."""
    rows = table(spark, sf, "embeddings")
    firsts = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("shared"))
    return rows.join(firsts, "label").select(
        "vec_id", F.when(F.pmod("vec_id", F.lit(3)) == 0, F.col("shared")).otherwise(F.col("embedding")).alias("embedding")
    )


def knn_graph_copies(spark, sf):
    return _rounded(neighbours.knn_graph(_with_copies(spark, sf), 5, "vec_id", "embedding", block_rows=100))


def fuzzy_weights(spark, sf):
    weights = neighbours.fuzzy_weights(neighbours.knn_graph(_embeddings(spark, sf), 15, "vec_id", "embedding"))
    return weights.withColumn("w", F.round("w", 6))


def perplexity_affinity(spark, sf):
    rows = _embeddings(spark, sf)
    n = rows.count()
    perplexity = neighbours.tsne_perplexity(n)
    graph = neighbours.knn_graph(rows, min(n - 1, 3 * perplexity), "vec_id", "embedding")
    affinities = neighbours.perplexity_affinities(graph, n, perplexity)
    return affinities.withColumn("p", F.round(F.col("p") * n, 6))


def neighbor_layout_umap(spark, sf):
    return layout.neighbour_layout(_embeddings(spark, sf), "UMAP", "vec_id", "embedding")


def neighbor_layout_tsne(spark, sf):
    return layout.neighbour_layout(_embeddings(spark, sf), "TSNE", "vec_id", "embedding")


def knn_descent_recall(spark, sf):
    """The refined graph against the exact one: all lists full, ranks without gaps, nine tenths of the entries found."""
    rows = _embeddings(spark, sf)
    refined = descent.knn_descent(rows, 15, "vec_id", "embedding", block_rows=128)
    exact = neighbours.knn_graph(rows, 15, "vec_id", "embedding").select("src", "dst", F.lit(1).alias("found"))
    lists = refined.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.count_if(F.col("src") == F.col("dst")).alias("own"))
    whole = lists.agg(F.count_if((F.col("n") == 15) & (F.col("last") == 15) & (F.col("own") == 0)).alias("whole_lists"))
    hits = refined.join(exact, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.count("found").alias("hits"))
    return whole.join(hits, F.lit(True)).select("whole_lists", "edges", (F.col("hits") >= 0.9 * F.col("edges")).alias("nine_tenths"))


def _kept(rows, axes, exact):
    """Share of the exact neighbours that are among the nearest in a picture."""
    picture = neighbours.knn_graph(rows.select("key", F.array(*[F.col(c).cast("float") for c in axes]).alias("v")), 15, "key", "v", normalize=False)
    return exact.join(picture.select("src", "dst", F.lit(1).alias("found")), ["src", "dst"], "left").agg(F.avg(F.coalesce("found", F.lit(0)))).first()[0]


def layout_facts(spark, sf):
    """Each layout places every row, and keeps more neighbours than principal components do.

    All pairs of vectors are compared once: both layouts and the comparison of pictures take their neighbours from one graph.
    """
    rows = with_row_key(_embeddings(spark, sf), "key")
    n = rows.count()
    wanted = max(15, *(layout.graph_neighbours(method, n) for method in ("UMAP", "TSNE")))
    near = cut_lineage(neighbours.knn_graph(rows, wanted, "key", "embedding"))
    exact = near.filter(F.col("rank") <= 15).select("src", "dst")
    scores = projection.pca(rows, 2, "embedding").project(rows, ["x", "y"])
    linear = _kept(scores, ("x", "y"), exact)
    facts = []
    for method in ("UMAP", "TSNE"):
        placed = layout.neighbour_layout(rows, method, "vec_id", "embedding", graph=near, key_col="key")
        finite = placed.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).join(rows.select("key", "vec_id"), "key")
        facts.append((method, finite.select("vec_id").distinct().count(), _kept(placed, ("x", "y"), exact) > linear))
    return spark.createDataFrame(facts, "method string, placed long, closer boolean")


def _edges(source: str, k: str) -> str:
    return f"""
    {source},
    long AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM rows),
    norms AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-10) AS norm FROM long GROUP BY vec_id),
    v AS (
      SELECT vec_id, list(CAST(CAST(x / norm AS FLOAT) AS DOUBLE) ORDER BY pos) AS v
      FROM long JOIN norms USING (vec_id) GROUP BY vec_id
    ),
    d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d),
    edges AS (SELECT src, dst, rank, dist FROM r WHERE rank <= {k})
    """


def _knn(source: str, k: int) -> str:
    return f"""
    WITH {_edges(source, str(k))}
    SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM edges
    """


def _bisected(level: str, target: str) -> str:
    """Find per row the scale ``s`` where the rising ``level`` of the list ``g`` meets the target, by halving."""
    return f"""
    steps AS (
      SELECT src, g, target, 0.0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1.0::DOUBLE AS s, 0 AS step FROM lists
      UNION ALL
      SELECT src, g, target, lo, hi, CASE WHEN isinf(hi) THEN least(s * 2, 1e30) ELSE (lo + hi) / 2 END, step + 1
      FROM (
        SELECT src, g, target, s, step, CASE WHEN {level} > {target} THEN lo ELSE s END AS lo,
               CASE WHEN {level} > {target} THEN s ELSE hi END AS hi
        FROM steps WHERE step < 100
      )
    ),
    scales AS (SELECT src, s FROM steps WHERE step = 100)
    """


_FUZZY = f"""
WITH RECURSIVE {_edges("rows AS (SELECT vec_id, embedding FROM embeddings)", "15")},
rho AS (SELECT src, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM edges GROUP BY src),
gaps AS (SELECT src, dst, rank, greatest(dist - rho, 0) AS gap FROM edges JOIN rho USING (src)),
lists AS (SELECT src, list(gap ORDER BY rank) AS g, log2(count(*)) AS target FROM gaps GROUP BY src),
{_bisected("list_sum(list_transform(g, lambda x: exp(-x / s)))", "target")},
w AS (SELECT src, dst, exp(-gap / s) AS w FROM gaps JOIN scales USING (src)),
pairs AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w)
SELECT src, dst, round(sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END, 6) AS w FROM pairs GROUP BY src, dst
"""

# With p proportional to exp(-x / s), the entropy is ln(sum exp(-x / s)) + mean of x / s under p.
_ENTROPY = """(
  ln(list_sum(list_transform(g, lambda x: exp(-x / s))))
  + list_sum(list_transform(g, lambda x: x / s * exp(-x / s))) / list_sum(list_transform(g, lambda x: exp(-x / s)))
)"""
_PERPLEXITY = f"""
WITH RECURSIVE {_edges(
    "rows AS (SELECT vec_id, embedding FROM embeddings), "
    "size AS (SELECT count(*) AS n, least(30, greatest(5, count(*) // 3)) AS perplexity FROM rows)",
    "(SELECT least(n - 1, 3 * perplexity) FROM size)",
)},
gaps AS (SELECT src, dst, rank, dist * dist - min(dist * dist) OVER (PARTITION BY src) AS gap FROM edges),
lists AS (
  SELECT src, list(gap ORDER BY rank) AS g, ln(least((SELECT perplexity FROM size), count(*))) AS target FROM gaps GROUP BY src
),
{_bisected(_ENTROPY, "target")},
raw AS (SELECT src, dst, exp(-gap / s) AS e FROM gaps JOIN scales USING (src)),
w AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY src) AS w FROM raw),
pairs AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w)
SELECT src, dst, round(sum(w) / 2, 6) AS p FROM pairs GROUP BY src, dst
"""


_ROWS = "rows AS (SELECT vec_id, embedding FROM embeddings)"
_COPIES = """
firsts AS (SELECT label, arg_min(embedding, vec_id) AS shared FROM embeddings GROUP BY label),
rows AS (
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN shared ELSE embedding END AS embedding FROM embeddings JOIN firsts USING (label)
)
"""

QUERIES = {
    "knn_graph": (knn_graph, _knn(_ROWS, 15)),
    "knn_graph_blocks": (knn_graph_blocks, _knn(_ROWS, 15)),
    "knn_graph_copies": (knn_graph_copies, _knn(_COPIES, 5)),
    "fuzzy_weights": (fuzzy_weights, _FUZZY),
    "perplexity_affinity": (perplexity_affinity, _PERPLEXITY),
    "knn_descent_recall": (
        knn_descent_recall,
        "SELECT count(*) AS whole_lists, CAST(15 * count(*) AS BIGINT) AS edges, true AS nine_tenths FROM embeddings",
    ),
    "layout_facts": (
        layout_facts,
        "SELECT method, count(*) AS placed, true AS closer FROM embeddings, (VALUES ('UMAP'), ('TSNE')) m(method) GROUP BY method",
    ),
    "neighbor_layout_umap": (neighbor_layout_umap, None),
    "neighbor_layout_tsne": (neighbor_layout_tsne, None),
}
