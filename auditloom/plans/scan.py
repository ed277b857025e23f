"""The whole scan of many snapshots as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.compare import compare_scans
from auditloom.operators.dependencies import dependency_findings
from auditloom.operators.files import (
    MAX_BYTES,
    MAX_FILE_BYTES,
    MAX_FILES,
    scan_volume,
    scanned_files,
    select_files,
    walk_key,
)
from auditloom.operators.findings import (
    MAX_FINDINGS,
    all_findings,
    dedup_findings,
    merge_external,
    open_findings,
    scan_summary,
    top_findings,
)
from auditloom.operators.history import history_findings
from auditloom.operators.manifests import ecosystem, manifest_items
from auditloom.operators.match import extract, hits_to_findings
from auditloom.session import broadcast_if_small, durable, per_scan
from auditloom.sources.reports import (
    external_findings,
    external_tool_names,
    external_tool_status,
)
from auditloom.sources.snapshot import snapshot_files, snapshot_listing


@dataclass(frozen=True)
class Limits:
    """Cuts of one scan; None means none."""

    max_files: int | None = None
    max_bytes: int | None = None
    max_file_bytes: int | None = None
    max_findings: int | None = None


# The usual cuts of a single scan.
USUAL_LIMITS = Limits(MAX_FILES, MAX_BYTES, MAX_FILE_BYTES, MAX_FINDINGS)


@dataclass(frozen=True)
class ScanResult:
    """``findings`` are all, before the cut; ``stored`` the ones kept per scan."""

    summary: DataFrame
    findings: DataFrame
    stored: DataFrame


def scan_snapshots(
    scans: DataFrame,
    files: DataFrame,
    git_log: DataFrame,
    reports: DataFrame,
    advisories: DataFrame,
    baselines: DataFrame,
    limits: Limits = Limits(),
    listing: DataFrame | None = None,
) -> ScanResult:
    """Scans every snapshot listed in ``scans``.

    ``scans`` has scan_id, history_available and advisories_available. Contents
    are read once: selection runs on metadata, its few cuts go to the readers,
    and what the rules and the manifests yield is written out before the parts
    that use it more than once. ``files`` holds the content of every regular file;
    where ``listing`` has the metadata of all files, it need only hold the files
    that are eligible and small enough.
    """
    listed = scans.select("scan_id", "history_available", "advisories_available")
    metadata = files if listing is None else listing
    selected = select_files(metadata, limits.max_files, limits.max_bytes, limits.max_file_bytes)
    volume = durable(scan_volume(selected, limits.max_files))
    cuts = broadcast_if_small(volume.filter("truncated").select("scan_id", "last_walk"))

    taken = scanned_files(files, cuts, limits.max_file_bytes)
    items = manifest_items(F.col("path"), F.col("_text"), npm_limit=None)
    raw = durable(extract(taken, dependencies=items))

    rule_findings = hits_to_findings(raw.filter(F.col("rule_ord").isNotNull()))
    path = F.col("path")
    inventory = raw.filter(F.col("rule_ord").isNull()).select(
        "scan_id",
        path.alias("file"),
        walk_key(path).alias("walk"),
        ecosystem(path).alias("ecosystem"),
        "name",
        "version",
        F.col("line_no").alias("pos"),
    )
    with_history = git_log.join(
        per_scan(listed.filter("history_available").select("scan_id")), "scan_id", "left_semi"
    )
    own = dedup_findings(
        all_findings(
            dependency_findings(inventory, advisories, baselines, listed),
            rule_findings,
            history_findings(with_history),
        )
    )
    external = external_findings(reports)
    findings = durable(open_findings(merge_external(own, external)))

    tools = external_tool_names(external_tool_status(reports, external))
    flags = listed.join(per_scan(tools), "scan_id", "left")
    summary = scan_summary(_every_scan(listed, volume), findings, flags, limits.max_findings)
    return ScanResult(summary, findings, top_findings(findings, limits.max_findings))


def scan_folders(
    spark: SparkSession,
    root: str,
    scans: DataFrame,
    git_log: DataFrame,
    reports: DataFrame,
    advisories: DataFrame,
    baselines: DataFrame,
    limits: Limits = Limits(),
) -> ScanResult:
    """Scans the snapshot folders below ``root``.

    Sizes and names are listed first, without opening a file. Then only files that are eligible and
    within the size limit are opened; larger ones count as skipped.
    """
    listing = durable(snapshot_listing(spark, root))
    files = snapshot_files(spark, root, limits.max_file_bytes, eligible=True)
    return scan_snapshots(
        scans, files, git_log, reports, advisories, baselines, limits, listing=listing)


def _every_scan(listed: DataFrame, volume: DataFrame) -> DataFrame:
    """Volume rows with zeros for snapshots that have no eligible file."""
    zero = F.lit(0).cast("long")
    return listed.select("scan_id").join(per_scan(volume), "scan_id", "left").select(
        "scan_id",
        F.coalesce("files_scanned", zero).alias("files_scanned"),
        F.coalesce("bytes_scanned", zero).alias("bytes_scanned"),
        F.coalesce("skipped_large_files", zero).alias("skipped_large_files"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        "truncation_reason",
    )


def compare_with_stored(
    result: ScanResult,
    previous_of: DataFrame,
    stored_scans: DataFrame,
    stored_findings: DataFrame,
) -> DataFrame:
    """Comparison of new scans with the stored earlier ones they name.

    ``previous_of`` has scan_id and previous_scan_id. Both sides are the cut
    lists; a scan whose predecessor is gone has no row.
    """
    key_columns = ["scan_id", "rule", "file", "line", "fingerprint"]
    new = result.summary.select("scan_id", "score").join(
        per_scan(previous_of.select("scan_id", "previous_scan_id")), "scan_id", "left"
    )
    scanned = per_scan(new.select("scan_id"))
    old = stored_scans.join(scanned, "scan_id", "left_anti").select(
        "scan_id", "score", F.lit(None).cast("string").alias("previous_scan_id")
    )
    wanted = new.select(F.col("previous_scan_id").alias("scan_id")).distinct().join(
        scanned, "scan_id", "left_anti"
    )  # an earlier scan that comes again is compared as it is now
    before = stored_findings.join(per_scan(wanted), "scan_id", "left_semi")
    return compare_scans(
        new.unionByName(old),
        result.stored.select(key_columns).unionByName(before.select(key_columns)),
    )
