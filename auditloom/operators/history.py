"""Secrets in added lines of commit history logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators.match import ordinal, rule_hit_array
from auditloom.rules import HISTORY_TOOL, SECRET_RULES, rule_texts
from auditloom.session import durable, per_scan

BLOCK_LINES = 100_000
NO_COMMIT, NO_FILE = "unknown", "git-history"
COMMIT_MARK, FILE_MARK = "commit:", "+++ b/"


def _commit():
    return F.when(
        F.col("line").startswith(COMMIT_MARK), F.substring("line", len(COMMIT_MARK) + 1, 12)
    )


def _file():
    return F.when(
        F.col("line").startswith(FILE_MARK), F.expr(f"substring(line, {len(FILE_MARK) + 1})")
    )


def _is_marker():
    return F.col("line").startswith(COMMIT_MARK) | F.col("line").startswith(FILE_MARK)


def _is_added():
    return F.col("line").startswith("+") & ~F.col("line").startswith("+++")


def _secret_hits():
    """Positions of the secret rules that match the line."""
    all_rules = F.lit(sum(1 << r.ord for r in SECRET_RULES))
    return rule_hit_array(F.col("line"), F.lower("line"), all_rules, SECRET_RULES)


def fill_history_context(git_log: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Adds the commit and file in force at each line of a log.

    A log may be long, so it is filled in blocks of ``seq``: the last marks of
    every block are reduced first, carried forward over the blocks and joined
    back, and no task sorts more than one block of lines.
    """
    blocked = git_log.withColumn("_block", F.floor(F.col("seq") / block_lines))
    last = blocked.filter(_is_marker()).groupBy("scan_id", "_block").agg(
        F.max_by(_commit(), F.when(_commit().isNotNull(), F.col("seq"))).alias("_commit"),
        F.max_by(_file(), F.when(_file().isNotNull(), F.col("seq"))).alias("_file"),
    )
    blocks = blocked.select("scan_id", "_block").distinct()
    earlier = Window.partitionBy("scan_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = blocks.join(per_scan(last), ["scan_id", "_block"], "left").select(
        "scan_id",
        "_block",
        F.last("_commit", ignorenulls=True).over(earlier).alias("_commit"),
        F.last("_file", ignorenulls=True).over(earlier).alias("_file"),
    )
    inside = Window.partitionBy("scan_id", "_block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        blocked.join(per_scan(carried), ["scan_id", "_block"], "left")
        .withColumn(
            "commit",
            F.coalesce(
                F.last(_commit(), ignorenulls=True).over(inside), "_commit", F.lit(NO_COMMIT)
            ),
        )
        .withColumn(
            "file",
            F.coalesce(F.last(_file(), ignorenulls=True).over(inside), "_file", F.lit(NO_FILE)),
        )
        .select("scan_id", "seq", "line", "commit", "file")
    )


def candidate_lines(git_log: DataFrame) -> DataFrame:
    """The marks, and the added lines that hit a secret rule, of all log lines."""
    hits = F.when(_is_added(), _secret_hits())
    return git_log.filter(_is_marker() | (F.size(hits) > 0)).select("scan_id", "seq", "line")


def history_findings(git_log: DataFrame) -> DataFrame:
    """Secret rules over the added lines of the logs.

    The log is read once: what the fill needs of it is written out first, as
    the fill goes over its input several times.
    """
    kept = fill_history_context(durable(candidate_lines(git_log)))
    rows = kept.filter(_is_added()).withColumn(
        "_rule", F.explode(F.transform(_secret_hits(), rule_texts))
    )
    rule, file, line = F.col("_rule.rule"), F.col("file"), F.col("line")
    return rows.select(
        "scan_id",
        ordinal(1, F.lit(""), F.lit(0), F.col("seq"), F.lit(0), rule),
        tx.history_finding_id(rule, F.col("commit"), file).alias("id"),
        "_rule.severity",
        "_rule.title",
        F.lit(HISTORY_TOOL).alias("tool"),
        "_rule.rule",
        tx.norm_path(file).alias("file"),
        F.lit(1).alias("line"),
        "_rule.explanation",
        tx.evidence(F.lit(True), line).alias("evidence"),
        "_rule.patch",
        "commit",
        tx.fingerprint(rule, file, line).alias("fingerprint"),
    )
