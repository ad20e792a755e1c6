"""Vector preparation, clustering, linear projection, cluster summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import clustering, preparation, projection, summary
from vectorlens.plans import workflows

SEED = 614


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


def _poisoned(spark, sf):
    """Vectors of different length, some zero, some with NaN or infinite elements."""
    changed = F.expr(
        """
        transform(embedding, (x, i) -> CASE
          WHEN vec_id % 7 = 0 AND i = 3 THEN float('NaN')
          WHEN vec_id % 11 = 0 AND i = 5 THEN float('-Infinity')
          ELSE x * float(vec_id % 5) END)
        """
    )
    return _embeddings(spark, sf).select("vec_id", changed.alias("embedding"))


def prep_normalize(spark, sf):
    prepared = preparation.with_prepared(_poisoned(spark, sf), "embedding")
    long = prepared.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return long.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def prep_report(spark, sf):
    found = preparation.report(_poisoned(spark, sf), "embedding")
    return found.select(
        "n", "d", "n_nonfinite", "n_near_zero", *[F.round(c, 6).alias(c) for c in ("norm_min", "norm_max", "norm_mean")]
    )


def memory_estimate(spark, sf):
    return preparation.memory_estimate(_embeddings(spark, sf), "embedding", ("PCA", "TSNE", "UMAP", "OTHER"))


def assign_nearest(spark, sf):
    rows = _embeddings(spark, sf)
    means = summary.label_means(rows, "label", "embedding")
    near = clustering.assign_to_table(rows, means, "vec_id", "embedding", "label", "mean")
    return near.select("vec_id", "cluster", F.round("dist2", 6).alias("dist2"))


def lloyd_two_steps(spark, sf):
    near = clustering.seeded_lloyd(_embeddings(spark, sf), 8, 2, "vec_id", "embedding")
    return near.select("vec_id", "cluster", F.round("dist2", 6).alias("dist2"))


def assign_nearest_blocks(spark, sf):
    """Blocks of rows against blocks of centers; ids of rows repeat or are null, and so is one id of a center."""
    rows = _embeddings(spark, sf)
    centers = rows.filter("vec_id % 3 = 0").select(F.nullif("vec_id", F.lit(30)).alias("cid"), "embedding")
    named = rows.select(F.nullif(F.pmod("vec_id", F.lit(50)), F.lit(7)).alias("id"), "embedding")
    near = clustering.assign_to_table(named, centers, "id", "embedding", "cid", "embedding", 200, 60)
    return near.select("id", "cluster", F.round("dist2", 6).alias("dist2"))


def lloyd_labels(spark, sf):
    """Lloyd to its fixed point from the ten lowest ids, with distance bounds."""
    rows = _embeddings(spark, sf)
    return clustering.lloyd_kmeans(rows, 10, "vec_id", "embedding", normalize=False).label(rows).select("vec_id", "prediction")


def lloyd_columns(spark, sf):
    """Label columns of several fits side by side, one of them with a single cluster."""
    rows = _embeddings(spark, sf)
    for k in (12, 3, 1):
        rows = clustering.add_label_column(rows, clustering.lloyd_kmeans(rows, k, "vec_id", "embedding", normalize=False), k)
    return rows.drop("embedding", "label")


def kmeans_labels(spark, sf):
    return clustering.kmeans_labels(_embeddings(spark, sf), 10, "vec_id", "embedding", SEED)


def kmeans_columns(spark, sf):
    rows = _embeddings(spark, sf)
    for k in (12, 3):
        rows = clustering.add_label_column(rows, clustering.kmeans(rows.select("embedding"), k, "embedding", SEED), k)
    return rows.drop("embedding")


def carry_labels(spark, sf):
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("uuid"), "lang")
    previous = _embeddings(spark, sf).select(
        F.col("vec_id").alias("uuid"),
        F.col("label").cast("string").alias("KMeans (k=10)"),
        F.pmod("label", F.lit(2)).cast("string").alias("KMeans (k=2)"),
    )
    return clustering.carry_label_columns(new, previous)


def carry_labels_repeated(spark, sf):
    """Ids that repeat or are null on both sides: every new row once, and labels on which the earlier rows agree."""
    new = table(spark, sf, "documents").select(F.nullif(F.pmod("doc_id", F.lit(60)), F.lit(5)).alias("uuid"), "doc_id")
    previous = _embeddings(spark, sf).select(
        F.nullif(F.pmod("vec_id", F.lit(80)), F.lit(9)).alias("uuid"),
        F.col("label").cast("string").alias("KMeans (k=10)"),
        F.pmod("vec_id", F.lit(2)).cast("string").alias("KMeans (k=2)"),
    )
    return clustering.carry_label_columns(new, previous)


def _loose_ids(spark, sf):
    """Embeddings under ids that repeat or are null."""
    key = F.when(F.pmod("vec_id", F.lit(9)) == 0, F.lit(None)).otherwise(F.floor(F.col("vec_id") / 2))
    return _embeddings(spark, sf).select(key.cast("long").alias("uuid"), "embedding", "label")


def _placed_rows(frame, axes):
    placed = [F.abs(c) < float("inf") for c in axes]
    both = placed[0] & placed[1]
    return frame.groupBy("uuid").agg(F.count(F.lit(1)).alias("n"), F.bool_and(both).alias("placed"))


def projection_rows(spark, sf):
    """Rows in are rows out of a layout, whatever their ids."""
    return _placed_rows(workflows.reduce_vectors(_loose_ids(spark, sf), "TSNE", "uuid", "embedding", iterations=1), ("x", "y"))


def cluster_rows(spark, sf):
    frame = workflows.cluster_and_project(_loose_ids(spark, sf), 5, "PCA", "uuid", "embedding", seed=SEED)
    return _placed_rows(frame, ("x", "y"))


def batch_rows(spark, sf):
    spec = {"method": "umap", "n_components": 2, "iterations": 1, "graph": "refined"}
    frame = workflows.batch_frame(_loose_ids(spark, sf), {"cluster_spec": {"n_clusters": 4}, "dim_reduction_spec": spec}, "uuid", "embedding")
    return _placed_rows(frame, ("dim_1", "dim_2"))


def mean_vector(spark, sf):
    return projection.mean_vector(_embeddings(spark, sf), "embedding").withColumn("mean", F.round("mean", 6))


def covariance(spark, sf):
    return projection.covariance(_embeddings(spark, sf), "embedding").withColumn("cov", F.round("cov", 6))


def pca_2d(spark, sf):
    rows = _embeddings(spark, sf)
    scores = projection.pca(rows, 2, "embedding").project(rows, ["x", "y"])
    return scores.select("vec_id", *[F.round(c, 6).alias(c) for c in ("x", "y")])


def pca_range_finder(spark, sf):
    """The same scores without a covariance matrix, as very wide vectors take them."""
    rows = _embeddings(spark, sf)
    scores = projection.pca(rows, 2, "embedding", wide=1).project(rows, ["x", "y"])
    return scores.select("vec_id", *[F.round(c, 3).alias(c) for c in ("x", "y")])


def cluster_workflow(spark, sf):
    return workflows.cluster_and_project(_embeddings(spark, sf), 10, "PCA", "vec_id", "embedding", seed=SEED, index=True)


def projection_workflow(spark, sf):
    return workflows.reduce_vectors(_embeddings(spark, sf), "PCA", "vec_id", "embedding").drop("embedding")


def batch_job(spark, sf):
    config = {
        "cluster_spec": {"n_clusters": 5, "rnd_state": 42},
        "dim_reduction_spec": {"method": "pca", "n_components": 3},
    }
    return workflows.batch_frame(_embeddings(spark, sf), config, "vec_id", "embedding")


def batch_job_umap(spark, sf):
    """Three coordinates of the neighbour layout on raw vectors; SQL states which rows come and that all are placed."""
    config = {"cluster_spec": {"n_clusters": 5, "rnd_state": 42}, "dim_reduction_spec": {"method": "umap", "n_components": 3}}
    frame = workflows.batch_frame(_embeddings(spark, sf), config, "vec_id", "embedding")
    size = F.abs("dim_1") + F.abs("dim_2") + F.abs("dim_3")
    return frame.select("vec_id", "label", (size < float("inf")).alias("placed"), F.col("cluster_label").isin(list("01234")).alias("labelled"))


def kmeans_checks(spark, sf):
    """Facts about a fit: labels in range, and rows whose label is not that of their nearest center."""
    rows = preparation.with_prepared(_embeddings(spark, sf), "embedding").select("embedding")
    fitted = clustering.kmeans(rows, 10, "embedding", SEED, normalize=False)
    near = clustering.assign_nearest(fitted.label(rows, "given"), list(range(fitted.k)), fitted.centers, "embedding")
    return near.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("given").between(0, 9)).alias("out_of_range"),
        F.count_if(F.col("given") != F.col("cluster")).alias("not_nearest"),
    )


def pca_checks(spark, sf):
    """Facts about the scores: centred, uncorrelated, the first with the larger variance."""
    rows = _embeddings(spark, sf)
    scores = projection.pca(rows, 2, "embedding").project(rows, ["x", "y"])
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.avg("x")) < 1e-6).alias("centred_x"),
        (F.abs(F.avg("y")) < 1e-6).alias("centred_y"),
        (F.abs(F.covar_samp("x", "y")) < 1e-6).alias("uncorrelated"),
        (F.variance("x") >= F.variance("y")).alias("ordered"),
    )


def cluster_summary(spark, sf):
    return summary.cluster_summary(_embeddings(spark, sf), "label", "embedding")


def representatives(spark, sf):
    near = summary.representatives(_embeddings(spark, sf), "label", "vec_id", "embedding")
    return near.withColumn("dist2", F.round("dist2", 6))


_LONG = """
base AS (
  SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings
)
"""
_POISONED = f"""
{_LONG},
poisoned AS (
  SELECT vec_id, pos, CASE WHEN vec_id % 7 = 0 AND pos = 3 THEN 'nan'::FLOAT
    WHEN vec_id % 11 = 0 AND pos = 5 THEN '-inf'::FLOAT ELSE x * CAST(vec_id % 5 AS FLOAT) END AS x FROM base
),
clean AS (SELECT vec_id, pos, NOT isfinite(x) AS bad, CASE WHEN isfinite(x) THEN x::DOUBLE ELSE 0 END AS z FROM poisoned),
norms AS (SELECT vec_id, sqrt(sum(z * z)) AS norm, sum(bad::INT) AS bad FROM clean GROUP BY vec_id)
"""
_PREPARED = f"""
{_LONG},
norms AS (SELECT vec_id, greatest(sqrt(sum(x::DOUBLE * x::DOUBLE)), 1e-10) AS norm FROM base GROUP BY vec_id),
prepared AS (
  SELECT vec_id, pos, CAST(CAST(x::DOUBLE / norm AS FLOAT) AS DOUBLE) AS z FROM base JOIN norms USING (vec_id)
)
"""
_MEANS = f"""
{_LONG},
mean_pos AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM base GROUP BY label, pos),
means AS (SELECT label, list(m ORDER BY pos) AS c FROM mean_pos GROUP BY label)
"""


def _lloyd(source: str, target: str) -> str:
    """One assign-and-average step from center table ``source(k, c)`` to ``target(k, c)``."""
    return f"""
    {target}_near AS (
      SELECT vec_id, arg_min(k, struct_pack(d := list_distance(v, c), k := k)) AS k FROM rows, {source} GROUP BY vec_id
    ),
    {target}_mean AS (
      SELECT k, pos, avg(x::DOUBLE) AS m FROM base JOIN {target}_near USING (vec_id) GROUP BY k, pos
    ),
    {target} AS (SELECT k, list(m ORDER BY pos) AS c FROM {target}_mean GROUP BY k)
    """


# Rounds of the recursion; the given tables reach the fixed point earlier, and stay there.
_LLOYD_ROUNDS = 60


def _lloyd_fixed(k: int, name: str) -> str:
    """Nearest of the fixed point's centers as table ``name(vec_id, k)``, from the k lowest ids."""
    return f"""
    {name}_c AS (
      SELECT 0 AS it, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS k, v AS c FROM (SELECT * FROM rows ORDER BY vec_id LIMIT {k})
      UNION ALL
      SELECT it, k, list(m ORDER BY pos) FROM (
        SELECT it, k, pos, avg(x::DOUBLE) AS m FROM (
          SELECT it + 1 AS it, vec_id, arg_min(k, struct_pack(d := list_distance(v, c), k := k)) AS k
          FROM {name}_c, rows WHERE it < {_LLOYD_ROUNDS} GROUP BY it, vec_id
        ) JOIN base USING (vec_id) GROUP BY it, k, pos
      ) GROUP BY it, k
    ),
    {name} AS (
      SELECT vec_id, arg_min(k, struct_pack(d := list_distance(v, c), k := k)) AS k
      FROM {name}_c, rows WHERE it = {_LLOYD_ROUNDS} GROUP BY vec_id
    )
    """


def _axis(source: str, name: str, squarings: int = 16) -> str:
    """Leading eigenvector ``name(i, v)`` of the matrix ``source(i, j, v)``, which is squared again and again."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {source} WHERE i = j) AS v FROM {source})"]
    for step in range(squarings):
        steps.append(
            f"{name}_s{step} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{step} a JOIN {name}_{step} b ON a.j = b.i GROUP BY a.i, b.j)"
        )
        steps.append(f"{name}_{step + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_s{step} WHERE i = j) AS v FROM {name}_s{step})")
    last = f"{name}_{squarings}"
    steps.append(f"{name}_col AS (SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
    steps.append(
        f"{name} AS MATERIALIZED (SELECT i, v * sign((SELECT arg_max(v, abs(v)) FROM {name}_col)) / (SELECT sqrt(sum(v * v)) FROM {name}_col) AS v FROM {name}_col)"
    )
    return ",\n".join(steps)


def _scores(digits: int) -> str:
    return f"""
WITH {_PREPARED},
means AS (SELECT pos, avg(z) AS m FROM prepared GROUP BY pos),
cov AS MATERIALIZED (
  SELECT a.pos AS i, b.pos AS j, covar_samp(a.z, b.z) AS v FROM prepared a JOIN prepared b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos
),
{_axis("cov", "first")},
size AS (SELECT sum(a.v * c.v * b.v) AS l FROM cov c JOIN first a ON a.i = c.i JOIN first b ON b.i = c.j),
rest AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT l FROM size) * a.v * b.v AS v FROM cov c JOIN first a ON a.i = c.i JOIN first b ON b.i = c.j),
{_axis("rest", "second")}
SELECT vec_id, round(sum((z - m) * f.v), {digits}) + 0.0 AS x, round(sum((z - m) * s.v), {digits}) + 0.0 AS y
FROM prepared JOIN means USING (pos) JOIN first f ON f.i = pos JOIN second s ON s.i = pos GROUP BY vec_id
"""


_LOOSE_ROWS = """
SELECT CASE WHEN vec_id % 9 = 0 THEN NULL ELSE vec_id // 2 END AS uuid, count(*) AS n, true AS placed FROM embeddings GROUP BY 1
"""

QUERIES = {
    "prep_normalize": (
        prep_normalize,
        f"""
        WITH {_POISONED}
        SELECT vec_id, pos, round(CAST(CAST(z / greatest(norm, 1e-10) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
        FROM clean JOIN norms USING (vec_id)
        """,
    ),
    "prep_report": (
        prep_report,
        f"""
        WITH {_POISONED}
        SELECT count(*) AS n, CAST((SELECT max(len(embedding)) FROM embeddings) AS INTEGER) AS d,
               CAST(sum(bad) AS BIGINT) AS n_nonfinite, count(*) FILTER (norm < 1e-10) AS n_near_zero,
               round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max, round(avg(norm), 6) AS norm_mean
        FROM norms
        """,
    ),
    "memory_estimate": (
        memory_estimate,
        """
        WITH s AS (SELECT count(*)::DOUBLE AS n, max(len(embedding))::DOUBLE AS d, 1024.0::DOUBLE * 1024 AS mb FROM embeddings),
        b AS (SELECT *, n * d * 4 / mb AS base FROM s)
        SELECT 'PCA' AS method, CAST(trunc(base * 2) AS BIGINT) AS mb FROM b
        UNION ALL SELECT 'TSNE', CAST(trunc(base * 4 + n * n * 4 / mb) AS BIGINT) FROM b
        UNION ALL SELECT 'UMAP', CAST(trunc(base * 3 + n * 15 * 4 / mb) AS BIGINT) FROM b
        UNION ALL SELECT 'OTHER', CAST(trunc(base * 3) AS BIGINT) FROM b
        """,
    ),
    "assign_nearest": (
        assign_nearest,
        f"""
        WITH {_MEANS}, d AS (
          SELECT e.vec_id, m.label, list_distance(CAST(e.embedding AS DOUBLE[]), m.c) AS d FROM embeddings e, means m
        )
        SELECT vec_id, arg_min(label, struct_pack(d := d, l := label)) AS cluster, round(min(d) * min(d), 6) AS dist2
        FROM d GROUP BY vec_id
        """,
    ),
    "lloyd_two_steps": (
        lloyd_two_steps,
        f"""
        WITH {_LONG},
        rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        c0 AS (
          SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS k, v AS c
          FROM (SELECT * FROM rows ORDER BY vec_id LIMIT 8)
        ),
        {_lloyd("c0", "c1")}, {_lloyd("c1", "c2")},
        d AS (SELECT vec_id, k, list_distance(v, c) AS d FROM rows, c2)
        SELECT vec_id, arg_min(k, struct_pack(d := d, k := k)) AS cluster, round(min(d) * min(d), 6) AS dist2
        FROM d GROUP BY vec_id
        """,
    ),
    "kmeans_labels": (kmeans_labels, None),
    "kmeans_columns": (kmeans_columns, None),
    "carry_labels": (
        carry_labels,
        """
        SELECT doc_id AS uuid, lang, CAST(label AS VARCHAR) AS "KMeans (k=10)", CAST(label % 2 AS VARCHAR) AS "KMeans (k=2)"
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id
        """,
    ),
    "mean_vector": (
        mean_vector,
        f"WITH {_PREPARED} SELECT pos, round(avg(z), 6) + 0.0 AS mean FROM prepared GROUP BY pos",
    ),
    "covariance": (
        covariance,
        f"""
        WITH {_PREPARED}
        SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.z, b.z), 6) + 0.0 AS cov
        FROM prepared a JOIN prepared b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos
        """,
    ),
    "pca_2d": (pca_2d, _scores(6)),
    "pca_range_finder": (pca_range_finder, _scores(3)),
    "projection_rows": (projection_rows, _LOOSE_ROWS),
    "cluster_rows": (cluster_rows, _LOOSE_ROWS),
    "batch_rows": (batch_rows, _LOOSE_ROWS),
    "carry_labels_repeated": (
        carry_labels_repeated,
        """
        WITH p AS (
          SELECT nullif(vec_id % 80, 9) AS uuid, CAST(label AS VARCHAR) AS a, CAST(vec_id % 2 AS VARCHAR) AS b FROM embeddings
        ), g AS (
          SELECT uuid, CASE WHEN min(a) = max(a) THEN min(a) END AS a, CASE WHEN min(b) = max(b) THEN min(b) END AS b FROM p GROUP BY uuid
        )
        SELECT nullif(doc_id % 60, 5) AS uuid, doc_id, g.a AS "KMeans (k=10)", g.b AS "KMeans (k=2)"
        FROM documents LEFT JOIN g ON nullif(doc_id % 60, 5) IS NOT DISTINCT FROM g.uuid
        """,
    ),
    "assign_nearest_blocks": (
        assign_nearest_blocks,
        """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        d AS (
          SELECT a.vec_id, nullif(b.vec_id, 30) AS cid, list_distance(a.v, b.v) AS d FROM v a, v b WHERE b.vec_id % 3 = 0
        ), n AS (SELECT vec_id, arg_min(struct_pack(c := cid), d) AS hit, min(d) AS d FROM d GROUP BY vec_id)
        SELECT nullif(vec_id % 50, 7) AS id, hit.c AS cluster, round(d * d, 6) AS dist2 FROM n
        """,
    ),
    "lloyd_labels": (
        lloyd_labels,
        f"""
        WITH RECURSIVE {_LONG}, rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        {_lloyd_fixed(10, "near")}
        SELECT vec_id, k AS prediction FROM near
        """,
    ),
    "lloyd_columns": (
        lloyd_columns,
        f"""
        WITH RECURSIVE {_LONG}, rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        {_lloyd_fixed(12, "twelve")}, {_lloyd_fixed(3, "three")}
        SELECT vec_id, CAST(a.k AS VARCHAR) AS "KMeans (k=12)", CAST(b.k AS VARCHAR) AS "KMeans (k=3)", '0' AS "KMeans (k=1)"
        FROM twelve a JOIN three b USING (vec_id)
        """,
    ),
    "cluster_workflow": (cluster_workflow, None),
    "projection_workflow": (projection_workflow, None),
    "batch_job": (batch_job, None),
    "batch_job_umap": (batch_job_umap, "SELECT vec_id, label, true AS placed, true AS labelled FROM embeddings"),
    "kmeans_checks": (kmeans_checks, "SELECT count(*) AS n, 0::BIGINT AS out_of_range, 0::BIGINT AS not_nearest FROM embeddings"),
    "pca_checks": (
        pca_checks,
        "SELECT count(*) AS n, true AS centred_x, true AS centred_y, true AS uncorrelated, true AS ordered FROM embeddings",
    ),
    "cluster_summary": (
        cluster_summary,
        f"""
        WITH {_MEANS}
        SELECT label AS "Cluster", count(DISTINCT vec_id) AS "Count",
               round(sum((x::DOUBLE - m) * (x::DOUBLE - m)) / count(DISTINCT vec_id), 3) AS "Variance"
        FROM base JOIN mean_pos USING (label, pos) GROUP BY label
        """,
    ),
    "representatives": (
        representatives,
        f"""
        WITH {_MEANS}, d AS (
          SELECT label, vec_id, sum((x::DOUBLE - m) * (x::DOUBLE - m)) AS dist2
          FROM base JOIN mean_pos USING (label, pos) GROUP BY label, vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist2, vec_id) AS rank FROM d)
        SELECT label AS cluster, CAST(rank AS INTEGER) AS rank, vec_id, round(dist2, 6) AS dist2 FROM r WHERE rank <= 3
        """,
    ),
}
