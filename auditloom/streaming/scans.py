"""Continuous scanning of arriving snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from auditloom.plans.scan import Limits, ScanResult, compare_with_stored, scan_snapshots
from auditloom.session import broadcast_if_small, durable, per_scan
from auditloom.streaming.sinks import (
    FOLD_EVERY,
    ONCE,
    fold_due,
    newest_by,
    newest_generation,
    read_before,
    read_since,
    write_batch,
    write_generation,
)

PER_SCAN = ("files", "git_log", "reports")
PRUNED_IDS = 1_000  # snapshots of a batch, at most, that the tables are filtered by instead of joined


@dataclass(frozen=True)
class SnapshotTables:
    """Tables a batch of snapshots is scanned from, by scan_id."""

    files: DataFrame
    git_log: DataFrame
    reports: DataFrame
    advisories: DataFrame
    baselines: DataFrame

    def of(self, announced: DataFrame) -> SnapshotTables:
        """Only the rows of the announced snapshots.

        The few ids of a small batch are a filter, with which Spark prunes partitions of tables laid
        out by scan_id; many are a semi join that merges. Every part of the scan would broadcast
        them again, each time for a page of the driver's memory.
        """
        ids = [r.scan_id for r in announced.select("scan_id").limit(PRUNED_IDS + 1).collect()]
        if len(ids) <= PRUNED_IDS:
            own = {n: getattr(self, n).filter(F.col("scan_id").isin(ids)) for n in PER_SCAN}
        else:
            held = per_scan(announced.select("scan_id"))
            own = {n: getattr(self, n).join(held, "scan_id", "left_semi") for n in PER_SCAN}
        return replace(self, **own)


def scan_stream(
    notices: DataFrame,
    tables: Callable[[], SnapshotTables],
    out: str,
    checkpoint: str,
    limits: Limits = Limits(),
    trigger: dict = ONCE,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Scans the snapshots announced by each micro-batch, each one whole.

    A notice (scan_id, history_available, advisories_available) is written once
    its snapshot is staged. ``tables`` is called for every batch and must read anew,
    so that rows staged since the last one are seen. The source's ``maxFilesPerTrigger`` bounds a batch.
    Scans are keyed by id: a repeated batch or a rescan replaces the earlier one
    for readers.

    Where notices also have previous_scan_id, each scan is compared with the one it names, as batches
    before stored it or as this batch scans it, and the comparison is stored with the scan. A scan whose
    predecessor is null or not stored has none. A repeated batch compares with the same rows again.

    Every ``fold_every`` batches the newest scan of each id, its findings and its comparison go into
    a generation, which readers take in place of the batches it holds.
    """
    compares = "previous_scan_id" in notices.columns

    def scan(batch: DataFrame, batch_id: int) -> None:
        announced = durable(batch.dropDuplicates(["scan_id"]))
        if announced.isEmpty():
            return
        own = tables().of(announced)
        result = scan_snapshots(
            announced, own.files, own.git_log, own.reports, own.advisories, own.baselines, limits
        )
        if compares:
            result = replace(result, summary=durable(result.summary), stored=durable(result.stored))
            told = _compared(result, announced, out, batch_id)
            write_batch(told, f"{out}/comparisons", batch_id)
        write_batch(result.stored, f"{out}/findings", batch_id)
        write_batch(result.summary, f"{out}/scans", batch_id)
        _fold(batch.sparkSession, out, batch_id, ["findings", "comparisons"] if compares else ["findings"], fold_every)

    return (
        notices.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(scan)
        .trigger(**trigger)
        .start()
    )


def _fold(spark: SparkSession, out: str, batch_id: int, parts: list[str], every: int) -> None:
    """A generation of the scans and of the tables that go with them, if one is due.

    That of the scans is written last: readers go by it, so the others are whole by then.
    """
    if not fold_due(spark, f"{out}/scans", batch_id, every):
        return
    last = newest_generation(spark, f"{out}/scans", batch_id)
    newest = durable(newest_by(read_since(spark, f"{out}/scans", last, batch_id + 1), ["scan_id"]))
    held = per_scan(newest.select("scan_id", "batch_id"))
    for part in parts:
        rows = read_since(spark, f"{out}/{part}", last, batch_id + 1)
        write_generation(rows.join(held, ["scan_id", "batch_id"], "left_semi"), f"{out}/{part}", batch_id)
    write_generation(newest, f"{out}/scans", batch_id)


def _compared(result: ScanResult, announced: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Comparison of a batch with the newest earlier state of the scans it names, and of those alone."""
    spark = announced.sparkSession
    named = broadcast_if_small(
        announced.select(F.col("previous_scan_id").alias("scan_id")).dropna().distinct())
    last = newest_generation(spark, f"{out}/scans", batch_id)
    earlier = read_before(spark, f"{out}/scans", batch_id, result.summary.schema, last)
    newest = durable(newest_by(earlier.join(named, "scan_id", "left_semi"), ["scan_id"]))
    found = read_before(spark, f"{out}/findings", batch_id, result.stored.schema, last)
    of_newest = per_scan(newest.select("scan_id", "batch_id"))
    held = found.join(of_newest, ["scan_id", "batch_id"], "left_semi")
    return compare_with_stored(result, announced, newest, held)


def _current(spark: SparkSession, out: str, part: str) -> DataFrame:
    """Rows of a table that go with the newest scan of each id, all read from one generation on."""
    last = newest_generation(spark, f"{out}/scans")
    scans = newest_by(read_since(spark, f"{out}/scans", last), ["scan_id"])
    if part == "scans":
        return scans
    held = per_scan(scans.select("scan_id", "batch_id"))
    return read_since(spark, f"{out}/{part}", last).join(held, ["scan_id", "batch_id"], "left_semi")


def current_comparisons(spark: SparkSession, out: str) -> DataFrame:
    """Comparisons of the newest scan of each id."""
    return _current(spark, out, "comparisons")


def current_scans(spark: SparkSession, out: str) -> DataFrame:
    return _current(spark, out, "scans")


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the newest scan of each id, also when that scan has none."""
    return _current(spark, out, "findings")
