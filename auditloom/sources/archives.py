"""Checks over archive entry lists and snapshot sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 20_000
MAX_SNAPSHOT_BYTES = 500_000_000

# Entry types that are never extracted.
UNSAFE_TYPES = ("SymbolicLink", "Link", "CharacterDevice", "BlockDevice", "FIFO")


def archive_verdicts(
    entries: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_SNAPSHOT_BYTES
) -> DataFrame:
    """Entries, declared bytes and rejection of each snapshot; unsafe entries count too."""
    totals = entries.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.coalesce("size", F.lit(0))).alias("declared_bytes"),
    )
    over = (F.col("entries") > max_entries) | (F.col("declared_bytes") > max_bytes)
    return totals.withColumn("rejected", over)


def guard_archive_entries(
    entries: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_SNAPSHOT_BYTES
) -> DataFrame:
    """Safe entries of the snapshots within both limits.

    Totals are reduced before the shuffle and rejected snapshots are taken out
    by an anti join, so no snapshot has to be sorted or held in one task.
    """
    rejected = archive_verdicts(entries, max_entries, max_bytes).filter("rejected")
    safe = entries.filter(~F.col("entry_type").isin(*UNSAFE_TYPES))
    return safe.join(rejected.select("scan_id"), "scan_id", "left_anti")


def snapshot_sizes(files: DataFrame, max_bytes: int = MAX_SNAPSHOT_BYTES) -> DataFrame:
    """Bytes of the regular files of each snapshot and whether they exceed the cap."""
    regular = F.when(F.col("entry_type") == "file", F.col("length"))
    return (
        files.groupBy("scan_id")
        .agg(F.coalesce(F.sum(regular), F.lit(0)).alias("clone_bytes"))
        .withColumn("rejected", F.col("clone_bytes") > max_bytes)
    )
