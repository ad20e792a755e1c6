"""Session helpers: a local session for tests and bench, and the shared folder for written state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "vectorlens") -> SparkSession:
    """Session used by the tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without; it gets a fresh folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vectorlens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table written once and read back."""
    return f"{shared_dir(spark).rstrip('/')}/vectorlens/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps the partitioning of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
