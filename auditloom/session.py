"""Session set-up and the helpers that cut lineage or check sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64_000_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a local session without one gets a folder of its own; on a cluster a
    missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="auditloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the checkpoint folder, for written tables."""
    return f"{_checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame, purpose: str = "rows") -> DataFrame:
    """Result written once as Parquet to the shared folder and read again: lineage is cut, and
    readers take only the columns they need."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_scan(df: DataFrame) -> DataFrame:
    """Hint for the right side of a join that has a row per scan: merged, never sent to the driver.

    Such tables grow with the scans, compressed files hide how much, and each broadcast costs the
    driver a page of some 34 MB however few rows it holds.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after measuring that the rows hold at most ``max_bytes``.

    Pass a durable or otherwise cheap frame. A larger one is merged, whatever its compressed
    files are estimated at, so the join becomes a shuffle join with AQE skew handling.
    """
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    held = df.agg(F.sum(width.cast("long")).alias("held")).first().held or 0
    return F.broadcast(df) if held <= max_bytes else df.hint("merge")
