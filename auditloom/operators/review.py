"""Reviewer decisions, remediation candidates and bulk explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.prompts import clean_reply, explanation_prompt
from auditloom.functions.slugs import branch_name, plan_path

# Accepted actions and the event type they are logged under.
ACTIONS = ("approve", "reject")
DECISION_EVENT = "finding_decision"
PULL_REQUEST_EVENT = "remediation_pull_request"


def valid_decisions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("action").isin(*ACTIONS))


def review_log(events: DataFrame, pull_requests: DataFrame | None = None) -> DataFrame:
    """Rows to append to the event log of a scan."""
    log = valid_decisions(events).select(
        "event_id",
        "scan_id",
        "finding_id",
        F.lit(DECISION_EVENT).alias("type"),
        "action",
        F.lit(None).cast("string").alias("pull_request"),
        "created_at",
    )
    if pull_requests is None:
        return log
    opened = pull_requests.select(
        "event_id",
        "scan_id",
        "finding_id",
        F.lit(PULL_REQUEST_EVENT).alias("type"),
        F.lit(None).cast("string").alias("action"),
        "pull_request",
        "created_at",
    )
    return log.unionByName(opened)


def latest_decisions(events: DataFrame) -> DataFrame:
    """Last valid decision per scan and finding id; any order of arrival will do."""
    newest = F.struct("created_at", "event_id")
    return (
        valid_decisions(events)
        .groupBy("scan_id", "finding_id")
        .agg(
            F.max_by("action", newest).alias("action"),
            F.max("created_at").alias("decided_at"),
        )
    )


def newest_decisions(events: DataFrame) -> DataFrame:
    """The rows that ``latest_decisions`` takes its values from; repeated and earlier ones go."""
    keys = ["scan_id", "finding_id"]
    rest = [c for c in events.columns if c not in keys]
    newest = F.struct("created_at", "event_id")
    return (
        valid_decisions(events)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), newest).alias("_row"))
        .select(*keys, "_row.*")
        .select(events.columns)
    )


def first_bearers(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """Finding ids collide; an id stands for the first finding that carries it.

    Only findings with an id in ``asked`` (scan_id, finding_id) are grouped.
    """
    keys = ["scan_id", "finding_id"]
    return (
        findings.select("scan_id", F.col("id").alias("finding_id"), "ord")
        .join(asked.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min("ord").alias("ord"))
    )


def apply_decisions(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with status, decision and decision time after all events."""
    latest = latest_decisions(events)
    decided = (
        latest.join(first_bearers(findings, latest), ["scan_id", "finding_id"])
        .select(
            "scan_id",
            "ord",
            F.col("action").alias("_action"),
            F.col("decided_at").alias("_at"),
        )
    )
    status = F.when(F.col("_action") == "reject", "dismissed").when(
        F.col("_action").isNotNull(), "approved"
    )
    joined = findings.join(decided, ["scan_id", "ord"], "left")
    return (
        joined.withColumn("status", F.coalesce(status, F.col("status")))
        .withColumn("decision", F.coalesce("_action", "decision"))
        .withColumn("decided_at", F.coalesce("_at", "decided_at"))
        .drop("_action", "_at")
    )


def apply_pull_requests(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings with the newest pull request that the event log holds for their id."""
    opened = (
        log.filter((F.col("type") == PULL_REQUEST_EVENT) & F.col("pull_request").isNotNull())
        .groupBy("scan_id", "finding_id")
        .agg(F.max_by("pull_request", F.struct("created_at", "event_id")).alias("_opened"))
    )
    placed = opened.join(first_bearers(findings, opened), ["scan_id", "finding_id"]).select(
        "scan_id", "ord", "_opened"
    )
    return (
        findings.join(placed, ["scan_id", "ord"], "left")
        .withColumn("remediation_pull_request", F.coalesce("_opened", "remediation_pull_request"))
        .drop("_opened")
    )


def open_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(
        F.count_if(F.col("status") == "open").cast("int").alias("open")
    )


def remediation_candidates(findings: DataFrame) -> DataFrame:
    """Approved findings without a pull request, one per scan and finding id."""
    waiting = findings.filter(
        (F.col("decision") == "approve") & F.col("remediation_pull_request").isNull()
    )
    rest = [c for c in findings.columns if c not in ("scan_id", "id")]
    first = waiting.groupBy("scan_id", "id").agg(
        F.min_by(F.struct(*rest), F.col("ord")).alias("_first")
    )
    return first.select("scan_id", "id", "_first.*")


def remediation_targets(
    candidates: DataFrame, at: str, branch_prefix: str, plan_folder: str
) -> DataFrame:
    """Branch and plan path of each candidate; ``at`` names the timestamp column."""
    return candidates.withColumns(
        {
            "branch": branch_name(branch_prefix, F.col("id"), F.col(at)),
            "plan_path": plan_path(plan_folder, F.col("id")),
        }
    )


def explanation_prompts(findings: DataFrame) -> DataFrame:
    return findings.select(
        "scan_id", "finding_key", "id", explanation_prompt().alias("prompt")
    )


def attach_explanations(findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds cleaned model replies (scan_id, finding_id, created_at, reply) to the first finding
    of the id. Of several usable replies the newest wins, the greater text in a tie."""
    cleaned = replies.select(
        "scan_id", "finding_id", "created_at", clean_reply(F.col("reply")).alias("_text")
    )
    usable = (
        cleaned.filter(F.col("_text").isNotNull())
        .groupBy("scan_id", "finding_id")
        .agg(F.max(F.struct("created_at", "_text"))["_text"].alias("_text"))
    )
    usable = usable.join(first_bearers(findings, usable), ["scan_id", "finding_id"]).select(
        "scan_id", "ord", "_text"
    )
    return (
        findings.join(usable, ["scan_id", "ord"], "left")
        .withColumn("ai_explanation", F.coalesce("_text", "ai_explanation"))
        .drop("_text")
    )
