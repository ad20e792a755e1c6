"""End-to-end jobs: projection, clustering with projection, and the configured batch job."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlens.functions.predicates import quoted
from vectorlens.functions.scalars import basename
from vectorlens.operators import clustering, layout, projection
from vectorlens.operators.ordering import with_row_index, with_row_key
from vectorlens.operators.preparation import with_prepared
from vectorlens.sources.sinks import write_labelled
from vectorlens.sources.tables import load_embeddings

METHODS = ("PCA", "TSNE", "UMAP")
# Key of a row from the start of a job to its end; ids of the caller may repeat or be null.
ROW_KEY = "__row_key"


def checked_method(method: str) -> str:
    name = method.upper()
    if name not in METHODS:
        raise ValueError(f"unsupported method {method!r}, choose one of {', '.join(METHODS)}")
    return name


def reduce_vectors(
    df: DataFrame,
    method: str = "PCA",
    id_col: str = "uuid",
    vec_col: str = "emb",
    seed: int | None = None,
    normalize: bool = True,
    iterations: int = layout.ITERATIONS,
    graph: str = "exact",
) -> DataFrame:
    """Add ``x, y``: centred principal component scores, or a neighbour-preserving layout on the exact or refined graph.

    Columns of these names are replaced. One row comes out for every row that goes in, whatever its id.
    """
    name = checked_method(method)
    df = df.drop("x", "y")
    if name == "PCA":
        return projection.pca(df, 2, vec_col, normalize).project(df, ["x", "y"])
    keyed = with_row_key(df, ROW_KEY)
    placed = layout.neighbour_layout(
        keyed, name, vec_col=vec_col, iterations=iterations, seed=seed or 0, normalize=normalize, graph=graph, key_col=ROW_KEY
    )
    return keyed.join(placed, ROW_KEY).drop(ROW_KEY)


def cluster_and_project(
    df: DataFrame,
    k: int,
    method: str = "PCA",
    id_col: str = "uuid",
    vec_col: str = "emb",
    path_col: str | None = None,
    seed: int | None = None,
    index: bool = False,
    graph: str = "exact",
) -> DataFrame:
    """K-Means in the full space, then two coordinates for display.

    Output: id, ``x, y, cluster`` (text), and with a path column ``image_path, file_name``; ``idx`` on
    request. Labels and linear scores are added row by row to one scan, so no join is needed. Vectors are prepared
    once per scan and used as they are from there on.
    """
    name = checked_method(method)
    needed = dict.fromkeys([id_col, vec_col] + ([path_col] if path_col else []))
    df = df.select(*[quoted(c) for c in needed])
    if name != "PCA":
        df = with_row_key(df, ROW_KEY)
    ready = with_prepared(df, vec_col)
    labelled = clustering.kmeans(ready, k, vec_col, seed, normalize=False).label(ready, "__label")
    if name == "PCA":
        scored = projection.pca(ready, 2, vec_col, normalize=False).project(labelled, ["x", "y"])
    else:
        placed = layout.neighbour_layout(df, name, vec_col=vec_col, seed=seed or 0, graph=graph, key_col=ROW_KEY)
        scored = labelled.join(placed, ROW_KEY)
    columns = [quoted(id_col), F.col("x"), F.col("y"), F.col("__label").cast("string").alias("cluster")]
    if path_col:
        columns += [quoted(path_col).alias("image_path"), basename(quoted(path_col)).alias("file_name")]
    out = scored.select(*columns)
    return with_row_index(out, [quoted(id_col)]) if index else out


def batch_frame(
    df: DataFrame,
    config: dict[str, Any],
    id_col: str = "uuid",
    vec_col: str = "emb",
    normalize: bool = False,
    keep_metadata: bool = True,
) -> DataFrame:
    """Metadata with ``dim_1..dim_c`` and ``cluster_label`` (text), as the batch job writes it.

    Without metadata the result is the id, the coordinates and an int label, and only id and vector are read.
    The batch job clusters and projects the vectors as they are, without normalizing them.
    """
    cluster_spec = config.get("cluster_spec") or {}
    reduction = config.get("dim_reduction_spec") or {}
    k = int(cluster_spec.get("n_clusters", 10))
    seed = int(cluster_spec.get("rnd_state", 614))
    components = int(reduction.get("n_components", 2))
    method = str(reduction.get("method") or reduction.get("model") or "pca").lower()
    if method not in ("pca", "umap"):
        raise ValueError(f"unsupported reduction {method!r}, choose pca or umap")
    dims = [f"dim_{i + 1}" for i in range(components)]
    df = df.drop(*dims, "cluster_label") if keep_metadata else df.select(quoted(id_col), quoted(vec_col))
    kept_columns = [c for c in df.columns if c != vec_col]
    if method == "umap":
        df = with_row_key(df, ROW_KEY)

    labelled = clustering.kmeans(df, k, vec_col, seed, normalize).label(df, "__label")
    if method == "pca":
        scored = projection.pca(df, components, vec_col, normalize).project(labelled, dims)
    else:
        rounds = int(reduction.get("iterations", layout.ITERATIONS))
        graph = str(reduction.get("graph", "exact"))
        placed = layout.neighbour_layout(
            df, "UMAP", vec_col=vec_col, iterations=rounds, seed=seed, normalize=normalize, names=dims, graph=graph, key_col=ROW_KEY
        )
        scored = labelled.join(placed, ROW_KEY)
    metadata = [quoted(c) for c in kept_columns]
    label = F.col("__label").cast("string" if keep_metadata else "int").alias("cluster_label")
    return scored.select(*metadata, *dims, label)


def run_job(
    spark: SparkSession,
    config: dict[str, Any] | str,
    id_col: str = "uuid",
    vec_col: str = "emb",
    normalize: bool = False,
    keep_metadata: bool = True,
) -> str:
    """Load with filters, cluster, project, and write; returns the path of the dataset.

    ``config`` is a dict, or the path of a JSON file with one, on any storage that Spark reads.
    """
    if isinstance(config, str):
        config = json.loads(spark.read.text(config, wholetext=True).first()[0])
    df = load_embeddings(spark, config["data_path"], id_col, vec_col, config.get("filters"))
    frame = batch_frame(df, config, id_col, vec_col, normalize, keep_metadata)
    return write_labelled(frame, config["output_dir"])
