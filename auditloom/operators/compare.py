"""Comparison of a scan with an earlier one, and score history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.session import per_scan


NO_RULE = "undefined"  # fixed value: stands for the rule of a finding that names none


def comparison_key() -> Column:
    """Fingerprint, or rule, file and line where there is none; never null."""
    return F.coalesce(
        tx.blank_to_null(F.col("fingerprint")),
        tx.finding_key(
            F.coalesce("rule", F.lit(NO_RULE)), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0))
        ),
    )


def rescan_pairs(scans: DataFrame) -> DataFrame:
    """Scans that name an earlier scan which still exists, with both scores."""
    current = scans.filter(F.col("previous_scan_id").isNotNull()).select(
        "scan_id", "previous_scan_id", "score"
    )
    earlier = scans.select(
        F.col("scan_id").alias("previous_scan_id"), F.col("score").alias("previous_score")
    )
    return current.join(per_scan(earlier), "previous_scan_id").select(
        "scan_id", "previous_scan_id", "score", "previous_score"
    )


def _keyed_counts(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows of the current and of the previous scan per comparison key.

    A finding counts in the pair of its own scan and in those that name its scan as the previous
    one. The counts are reduced before the shuffle, so keys travel twice: to their pairs, and summed.
    """
    sides = F.array(
        F.struct(F.col("scan_id").alias("side_id"), F.lit(True).alias("is_now")),
        F.struct(F.col("previous_scan_id").alias("side_id"), F.lit(False).alias("is_now")),
    )
    links = pairs.select(F.col("scan_id").alias("pair"), F.inline(sides))
    keyed = findings.select("scan_id", comparison_key().alias("key"))
    linked = keyed.join(per_scan(links), F.col("side_id") == F.col("scan_id"))
    counted = linked.groupBy("pair", "key")
    return counted.agg(
        F.count_if(F.col("is_now")).alias("now"), F.count_if(~F.col("is_now")).alias("before"),
    ).withColumnRenamed("pair", "scan_id")


def compare_scans(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """New, fixed and unchanged findings of each rescan, and its score change.

    Both sides are counted per key in one aggregation instead of a semi and two
    anti joins. ``findings`` are the stored ones, that is after the top-k cut;
    pass the full ones to compare without it.
    """
    pairs = rescan_pairs(scans)
    counts = (
        _keyed_counts(pairs, findings)
        .groupBy("scan_id")
        .agg(
            F.sum(F.when(F.col("before") == 0, F.col("now"))).alias("_new"),
            F.sum(F.when(F.col("now") == 0, F.col("before"))).alias("_fixed"),
            F.sum(F.when(F.col("before") > 0, F.col("now"))).alias("_same"),
        )
    )
    zero = F.lit(0).cast("long")
    return pairs.join(per_scan(counts), "scan_id", "left").select(
        "scan_id",
        "previous_scan_id",
        (F.col("score") - F.col("previous_score")).alias("score_change"),
        F.coalesce("_new", zero).alias("new_findings"),
        F.coalesce("_fixed", zero).alias("fixed_findings"),
        F.coalesce("_same", zero).alias("unchanged_findings"),
    )


def new_findings(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Current findings whose key the previous scan lacks."""
    return _one_sided(pairs, findings, "left_anti", current=True)


def unchanged_findings(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Current findings whose key the previous scan has."""
    return _one_sided(pairs, findings, "left_semi", current=True)


def fixed_findings(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Previous findings whose key the current scan lacks."""
    return _one_sided(pairs, findings, "left_anti", current=False)


def _one_sided(pairs: DataFrame, findings: DataFrame, how: str, current: bool) -> DataFrame:
    keyed = findings.withColumn("key", comparison_key())
    links = pairs.select(F.col("scan_id").alias("pair"), "previous_scan_id")
    now = keyed.join(
        links.select("pair", F.col("pair").alias("scan_id")), "scan_id"
    )
    before = keyed.join(
        links.select("pair", F.col("previous_scan_id").alias("scan_id")), "scan_id"
    )
    left, right = (now, before) if current else (before, now)
    return left.join(right.select("pair", "key").distinct(), ["pair", "key"], how)


def score_history(scans: DataFrame, block: str = "hour") -> DataFrame:
    """Score of each scan of a repository and its change from the one before.

    One repository may hold a large share of all scans, so the lag is taken in
    time blocks; only the last scan of every block is carried to the next.
    """
    blocked = scans.select(
        "url", "scan_id", "created_at", "score",
        F.date_trunc(block, F.col("created_at")).alias("_block"),
    )
    when = F.struct("created_at", "scan_id")
    last = blocked.groupBy("url", "_block").agg(F.max_by("score", when).alias("_last"))
    over_blocks = Window.partitionBy("url").orderBy("_block")
    carried = last.select("url", "_block", F.lag("_last").over(over_blocks).alias("_carried"))
    inside = Window.partitionBy("url", "_block").orderBy("created_at", "scan_id")
    return (
        blocked.join(carried, ["url", "_block"])
        .withColumn("_before", F.coalesce(F.lag("score").over(inside), F.col("_carried")))
        .select(
            "url", "scan_id", "created_at", "score",
            (F.col("score") - F.col("_before")).alias("score_change"),
        )
    )
