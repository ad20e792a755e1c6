"""Sinks: labelled dataset, per-cluster copies of files, and their manifest."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.functions.predicates import quoted
from vectorlens.functions.scalars import basename
from vectorlens.session import cut_lineage

# File names of the written results.
LABELLED_NAME = "processed_data.parquet"
REPARTITION_MANIFEST = "cluster_summary.csv"
SAVED_MANIFEST = "saved_cluster_summary.csv"
# What could not be copied stands beside the manifest, under its name with this in front.
FAILED_PREFIX = "failed_"
# Bytes of a file that a copy holds at once.
COPY_BYTES = 4 << 20


def write_labelled(df: DataFrame, output_dir: str, partition_by: str | None = None) -> str:
    """Write metadata, coordinates and labels as one parquet dataset; the vectors stay behind."""
    path = f"{output_dir.rstrip('/')}/{LABELLED_NAME}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def cluster_manifest(
    df: DataFrame, target_dir: str, path_col: str = "image_path", label_col: str = "cluster"
) -> DataFrame:
    """``(source, abs_path, file_name, cluster, collides)``: where each file goes.

    ``collides`` marks names that occur more than once in a cluster: copying would overwrite. The counts are
    made per (cluster, name) and joined back, so no group of rows has to meet in one window.
    """
    label = quoted(label_col).cast("string")
    root = target_dir.rstrip("/") if ":" in target_dir else os.path.abspath(target_dir)
    rows = df.select(
        quoted(path_col).alias("source"),
        basename(quoted(path_col)).alias("file_name"),
        label.alias("cluster"),
    )
    repeated = (
        rows.groupBy("cluster", "file_name")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select("cluster", "file_name", F.lit(True).alias("collides"))
    )
    return rows.join(repeated, ["cluster", "file_name"], "left").select(
        "source",
        F.concat(F.lit(f"{root}/cluster_"), "cluster", F.lit("/"), "file_name").alias("abs_path"),
        "file_name",
        "cluster",
        F.coalesce("collides", F.lit(False)).alias("collides"),
    )


def selected_manifest(
    df: DataFrame, clusters: list[str], target_dir: str, path_col: str = "image_path", label_col: str = "cluster"
) -> DataFrame:
    """The manifest restricted to selected clusters."""
    chosen = df.filter(quoted(label_col).cast("string").isin([str(c) for c in clusters]))
    return cluster_manifest(chosen, target_dir, path_col, label_col)


def distinct_targets(manifest: DataFrame) -> DataFrame:
    """Replace ``abs_path`` of files whose names collide: a hash of the source stands before the extension.

    Sources are told apart by 64 bits, without a count or an order over the files of a cluster.
    """
    mark = F.concat(F.lit("-"), F.lpad(F.lower(F.hex(F.xxhash64("source"))), 16, "0"))
    ending = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    stem = F.col("abs_path").substr(F.lit(1), F.length("abs_path") - F.length(ending))
    path = F.when(F.col("collides"), F.concat(stem, mark, ending)).otherwise(F.col("abs_path"))
    return manifest.withColumn("abs_path", path)


def _opened(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    plain = unquote(urlparse(path).path) if path.startswith("file:") else path
    return fs.LocalFileSystem(), plain


def _copy(source: str, target: str, task: str) -> str | None:
    """Copy under a name of the task's own, then rename; the reason if that failed."""
    try:
        from_system, from_path = _opened(source)
        to_system, to_path = _opened(target)
        part = f"{to_path}.{task}.part"
        to_system.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
        try:
            with from_system.open_input_stream(from_path) as given, to_system.open_output_stream(part) as kept:
                while chunk := given.read(COPY_BYTES):
                    kept.write(chunk)
            to_system.move(part, to_path)
        except BaseException:
            if to_system.get_file_info(part).is_file:
                to_system.delete_file(part)
            raise
    except (OSError, ValueError) as failure:
        return f"{type(failure).__name__}: {failure}"
    return None


def copy_report(manifest: DataFrame) -> DataFrame:
    """Copy each file of a manifest on the executors: ``(source, abs_path, file_name, cluster, copied, reason)``.

    Targets are distinct. A file appears under its name only when it is whole, so that a repeated or a second task finds
    and leaves whole files. Folders are on storage that all executors see: mounted, or any file system pyarrow opens
    by its address. A file that cannot be copied is a row with the reason.
    """

    def copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            reasons = [_copy(source, target, task) for source, target in zip(batch["source"], batch["abs_path"])]
            yield batch.assign(copied=[r is None for r in reasons], reason=reasons)

    wanted = distinct_targets(manifest).select("source", "abs_path", "file_name", "cluster")
    return wanted.mapInPandas(
        copy_batches, "source string, abs_path string, file_name string, cluster string, copied boolean, reason string"
    )


def copy_files(manifest: DataFrame) -> DataFrame:
    """The copied files of a manifest: ``(abs_path, file_name, cluster)``."""
    return copy_report(manifest).filter("copied").select("abs_path", "file_name", "cluster")


def _copied_with_manifest(manifest: DataFrame, target_dir: str, name: str) -> DataFrame:
    """Copy once, write the manifest of what was copied, and beside it what was not, with the reasons."""
    report = cut_lineage(copy_report(manifest))
    failed = report.filter(~F.col("copied")).select("source", "abs_path", "file_name", "cluster", "reason")
    if not failed.isEmpty():
        failed.write.mode("overwrite").csv(f"{target_dir.rstrip('/')}/{FAILED_PREFIX}{name}", header=True)
    return write_manifest(report.filter("copied").select("abs_path", "file_name", "cluster"), target_dir, name)


def write_manifest(copied: DataFrame, target_dir: str, name: str = REPARTITION_MANIFEST) -> DataFrame:
    """Write the manifest as a CSV dataset (a folder of parts) and read it back, so that the copies run once."""
    path = f"{target_dir.rstrip('/')}/{name}"
    copied.write.mode("overwrite").csv(path, header=True)
    return copied.sparkSession.read.csv(path, header=True, schema="abs_path string, file_name string, cluster string")


def repartition_by_cluster(
    df: DataFrame, target_dir: str, path_col: str = "image_path", label_col: str = "cluster"
) -> DataFrame:
    """Copy every file into the folder of its cluster and write the manifest."""
    manifest = cluster_manifest(df, target_dir, path_col, label_col)
    return _copied_with_manifest(manifest, target_dir, REPARTITION_MANIFEST)


def save_clusters(
    df: DataFrame, clusters: list[str], target_dir: str, path_col: str = "image_path", label_col: str = "cluster"
) -> DataFrame:
    """Copy the files of selected clusters and write the manifest."""
    manifest = selected_manifest(df, clusters, target_dir, path_col, label_col)
    return _copied_with_manifest(manifest, target_dir, SAVED_MANIFEST)
