"""Union, dedup, scores, top-k and summaries of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions.severity import severity_level, severity_rank, severity_weight
from auditloom.operators.topk import first_per_group, ranked_per_group
from auditloom.rules import ADVISORY_TOOL, CONTEXT_TOOL, HISTORY_TOOL, SECRET_TOOL, SOURCE_TOOL
from auditloom.session import per_scan

MAX_FINDINGS = 1_000
FULL_SCORE = 100

FINDING_COLUMNS = (
    "scan_id", "ord", "id", "severity", "title", "tool", "rule", "file", "line",
    "explanation", "evidence", "patch", "commit", "fingerprint",
)


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts]
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per rule, file and line: the last one's values, the first one's place.

    Both aggregates are reduced before the shuffle, so a key that repeats in
    very many history lines does not travel whole.
    """
    values = [c for c in FINDING_COLUMNS if c not in ("scan_id", "ord")]
    keyed = findings.withColumn(
        "finding_key", tx.finding_key(F.col("rule"), F.col("file"), F.col("line"))
    )
    return (
        keyed.groupBy("scan_id", "finding_key")
        .agg(
            F.max_by(F.struct(*values), F.col("ord")).alias("_last"),
            F.min("ord").alias("ord"),
        )
        .select("scan_id", "finding_key", "ord", "_last.*")
    )


def open_findings(findings: DataFrame) -> DataFrame:
    """Adds the review columns of a new finding."""
    return (
        findings.withColumn("status", F.lit("open"))
        .withColumn("decision", F.lit(None).cast("string"))
        .withColumn("decided_at", F.lit(None).cast("timestamp"))
    )


def merge_external(findings: DataFrame, external: DataFrame) -> DataFrame:
    """External findings behind the de-duplicated ones, themselves not de-duplicated."""
    keyed = external.withColumn(
        "finding_key", tx.finding_key(F.col("rule"), F.col("file"), F.col("line"))
    )
    return findings.unionByName(keyed.select(*findings.columns))


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_total"),
        F.count_if(F.col("severity") == "high").alias("high_total"),
        F.sum(severity_weight(F.col("severity"))).alias("weight"),
    )


def security_scores(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Score of every snapshot; one without findings keeps the full score."""
    lost = findings.groupBy("scan_id").agg(
        F.sum(severity_weight(F.col("severity"))).alias("weight")
    )
    score = F.greatest(F.lit(0), F.lit(FULL_SCORE) - F.coalesce("weight", F.lit(0)))
    return scans.select("scan_id").join(per_scan(lost), "scan_id", "left").select(
        "scan_id", score.cast("int").alias("score")
    )


def top_findings(
    findings: DataFrame, k: int | None = None, order: Sequence[str] = ("ord",), distinct: bool = False
) -> DataFrame:
    """First ``k`` findings of each snapshot by severity, stable in finding order, or all of them.

    ``position`` numbers them from 1; no task holds all findings of a hot snapshot. ``order`` names
    the columns of the finding order, which must not tie. With ``distinct``, equal rows count once.
    """
    ranked = findings.withColumn("_rank", severity_rank(F.col("severity")))
    if k is None:
        return ranked_per_group(ranked, ["scan_id"], ["_rank", *order], distinct=distinct).drop("_rank")
    return first_per_group(
        ranked.distinct() if distinct else ranked,
        ["scan_id"],
        [F.col("_rank"), *[F.col(c) for c in order]],
        k,
        salt_on=["finding_key", *order],
    ).drop("_rank")


def scan_summary(
    volume: DataFrame,
    findings: DataFrame,
    scanner_flags: DataFrame,
    k: int | None = None,
) -> DataFrame:
    """Summary row per snapshot.

    ``findings`` are all findings, before the cut to ``k``, if there is one. Sorted by severity
    the cut keeps criticals first and then highs, so the counts after it follow
    from the counts before; the score stays that of all findings.
    ``scanner_flags`` has scan_id, history_available and external_tools (array).
    """
    totals = severity_totals(findings)
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    total, critical, high = n("total_findings"), n("critical_total"), n("high_total")
    kept = total if k is None else F.least(total, F.lit(k))
    kept_critical = F.least(critical, kept)
    kept_high = F.least(high, kept - kept_critical)
    none = F.array().cast("array<string>")
    scanners = F.concat(
        F.array(F.lit(SOURCE_TOOL), F.lit(CONTEXT_TOOL), F.lit(SECRET_TOOL)),
        F.when(F.coalesce("history_available", F.lit(False)), F.array(F.lit(HISTORY_TOOL)))
        .otherwise(none),
        F.array(F.lit(ADVISORY_TOOL)),
        F.coalesce(F.col("external_tools"), none),
    )
    return (
        volume.join(per_scan(totals), "scan_id", "left")
        .join(per_scan(scanner_flags), "scan_id", "left")
        .select(
            "scan_id",
            F.greatest(F.lit(0), F.lit(FULL_SCORE) - n("weight")).cast("int").alias("score"),
            kept.cast("int").alias("open"),
            F.lit(0).alias("resolved"),
            kept_critical.cast("int").alias("critical"),
            kept_high.cast("int").alias("high"),
            "files_scanned",
            "bytes_scanned",
            "skipped_large_files",
            "truncated",
            "truncation_reason",
            scanners.alias("scanners"),
            total.cast("int").alias("total_findings"),
            kept.cast("int").alias("findings_returned"),
            (total > kept).alias("findings_truncated"),
        )
    )


def report_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules per snapshot: the last one's texts at the first one's place."""
    texts = F.struct("title", "explanation", "severity")
    return (
        findings.groupBy("scan_id", "rule")
        .agg(
            F.max_by(texts, F.col("position")).alias("_last"),
            F.min("position").alias("first_position"),
        )
        .select(
            "scan_id",
            "rule",
            "first_position",
            F.col("_last.title").alias("title"),
            F.col("_last.explanation").alias("explanation"),
            severity_level(F.col("_last.severity")).alias("level"),
        )
    )


def severity_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def scanner_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "tool").agg(F.count(F.lit(1)).alias("findings"))
