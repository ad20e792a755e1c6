"""Image folders: listing, and embedding with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions.predicates import quoted
from vectorlens.functions.vectors import VECTOR

# Raster formats, compared in lower case.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")

# Encodes one batch of file contents. A row is a vector, or None where the content cannot be read.
Encoder = Callable[[Sequence[bytes]], Sequence["np.ndarray | None"]]


def has_extension(path_col: str, extensions: Sequence[str]):
    """Case-insensitive extension match."""
    name = F.lower(quoted(path_col))
    matched = F.lit(False)
    for extension in extensions:
        matched = matched | name.endswith(extension.lower())
    return matched


# Paths that the driver holds before it passes them on.
LISTED_AT_ONCE = 20_000


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, recursive: bool = False) -> DataFrame:
    """``(path, length)`` of the files of a folder, empty ones included, on any file system that Hadoop knows.

    Without ``recursive`` only the folder itself is read, however deep the tree below it. Names are streamed from the file
    system and passed on in portions; like Spark's own listing, this runs on the driver. Names with a dot in front are
    left out. Extensions are compared in lower case.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    endings = tuple(e.lower() for e in extensions)
    # listStatusIterator stays in one folder; listFiles walks the tree.
    entries = system.listFiles(root, True) if recursive else system.listStatusIterator(root)
    parts, rows = [], []
    schema = "path string, length long"
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if entry.isFile() and not name.startswith(".") and name.lower().endswith(endings):
            rows.append((entry.getPath().toString(), entry.getLen()))
        if len(rows) >= LISTED_AT_ONCE:
            parts.append(spark.createDataFrame(rows, schema))
            rows = []
    parts.append(spark.createDataFrame(rows, schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _plain(folder: str) -> str:
    """A folder as a pattern in which special characters stand for themselves."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in folder.rstrip("/"))


def _glob(folder: str, extensions: Sequence[str]) -> str:
    """Pattern for the files of one folder by extension, in any case."""
    endings = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return f"{_plain(folder)}/*{{{','.join(endings)}}}"


def image_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, recursive: bool = False
) -> DataFrame:
    """``(path, content)`` of the image files. Content is read only by plans that use it.

    Files with content are read by Spark, from the folder alone unless ``recursive``; empty files, which its file
    sources skip, come from the listing.
    """
    listed = list_files(spark, folder, extensions, recursive)
    empty = listed.filter("length = 0").select("path", F.lit(b"").alias("content"))
    if listed.filter("length > 0").isEmpty():
        return empty
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", True).load(_plain(folder)) if recursive else reader.load(_glob(folder, extensions))
    files = files.filter(has_extension("path", extensions) & (F.col("length") > 0)).select("path", "content")
    return files.unionByName(empty)


def list_image_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, recursive: bool = False
) -> DataFrame:
    """Sorted full paths."""
    return list_files(spark, folder, extensions, recursive).select("path").sort("path")


def embed_contents(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    path_col: str = "path",
    content_col: str = "content",
    batch_size: int = 32,
    keep_failed: bool = False,
) -> DataFrame:
    """``(path, emb)`` from file contents; unreadable files are left out, or kept with a null vector.

    The encoder is built once per task and called on batches, so a model loads once per task.
    """
    path_type = df.schema[path_col].dataType
    schema = T.StructType([T.StructField(path_col, path_type), T.StructField("emb", VECTOR)])

    def encode_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                found = encode(part.column(1).to_pylist())
                rows = [None if v is None else np.asarray(v, dtype=np.float32) for v in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.float32()))], names=[path_col, "emb"]
                )

    inputs = df.select(quoted(path_col), quoted(content_col).cast("binary"))
    embedded = inputs.mapInArrow(encode_stream, schema)
    return embedded if keep_failed else embedded.filter(F.col("emb").isNotNull())


def embed_image_folder(
    spark: SparkSession,
    folder: str,
    make_encoder: Callable[[], Encoder],
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
    recursive: bool = False,
    batch_size: int = 32,
) -> DataFrame:
    """``(path, emb)`` of every readable image in a folder."""
    return embed_contents(image_files(spark, folder, extensions, recursive), make_encoder, batch_size=batch_size)


def embedding_counts(embedded: DataFrame) -> DataFrame:
    """``(total, embedded, skipped)`` of a frame made with ``keep_failed``."""
    done = F.count("emb")
    total = F.count(F.lit(1))
    return embedded.agg(total.alias("total"), done.alias("embedded"), (total - done).alias("skipped"))
