"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import compare, dependencies, files, findings, history, manifests
from auditloom.operators import match, review
from auditloom.plans.scan import ScanResult, scan_snapshots
from auditloom.rules import LINE_RULES, RULES
from auditloom.session import durable, per_scan, shared_folder
from auditloom.sources.advisories import advisories_from_replies
from auditloom.sources import archives, documents, exports, history_log, reports, repositories, snapshot
from auditloom.sources import store
from auditloom.streaming import decisions, expiry, jobs, rates, scans, sinks
from workload import views as v

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the limit operators, small enough to bite at every scale.
MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 6, 20_000, 8_000
TOP_K = 3
LISTED = 50
NOW = datetime(2002, 1, 1, tzinfo=timezone.utc)
JOB_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
TOOL_NAME = "Auditloom"
BRANCH_PREFIX, PLAN_FOLDER = "audit fix/plan", ".audit"

FLAT = (
    "scan_id", "id", "severity", "title", "tool", "rule", "file", "line", "explanation",
    "evidence", "patch", "fingerprint",
)


def flat(df: DataFrame, *more: str) -> DataFrame:
    """Finding rows with the patch as text."""
    return df.withColumn("patch", F.array_join("patch", "\n")).select(*FLAT, *more)


# --- files, lines, windows -------------------------------------------------------


def eligible_files(spark, sf):
    return files.eligible_files(v.code_files(spark, sf)).select("scan_id", "path", "length")


def pruned_directories(spark, sf):
    return files.prune_directories(v.code_files(spark, sf)).select("scan_id", "path")


def file_limit(spark, sf):
    listed = files.eligible_files(v.code_files(spark, sf)).select("scan_id", "path", "length")
    return files.limit_files(listed, MAX_FILES).select("scan_id", "path", "file_ord")


def byte_budget(spark, sf):
    return files.select_files(
        v.code_files(spark, sf), MAX_FILES, MAX_BYTES, MAX_FILE_BYTES
    ).select("scan_id", "path", "file_ord", "running_bytes", "is_large", "taken")


def whole_budget(spark, sf):
    """The byte budget over all files of a snapshot, without a file limit."""
    selected = files.select_files(v.code_files(spark, sf), None, MAX_BYTES, MAX_FILE_BYTES)
    return selected.select("scan_id", "path", "running_bytes", "is_large", "taken")


def scan_volume(spark, sf):
    selected = files.select_files(v.code_files(spark, sf), MAX_FILES, MAX_BYTES, MAX_FILE_BYTES)
    return files.scan_volume(selected, MAX_FILES).drop("last_walk")


def scanned_files(spark, sf):
    code = v.code_files(spark, sf)
    selected = files.select_files(code, MAX_FILES, MAX_BYTES, MAX_FILE_BYTES)
    cuts = files.scan_volume(selected, MAX_FILES).filter("truncated")
    return files.scanned_files(code, cuts, MAX_FILE_BYTES).select(
        "scan_id", "path", F.sha2("content", 256).alias("content_sha")
    )


def snapshot_source(spark, sf):
    """The code files as folders, read back by the snapshot source: eligible and small ones."""
    root = v.snapshot_folders(spark, sf)
    wanted = snapshot.snapshot_files(spark, root, MAX_FILE_BYTES, eligible=True)
    return wanted.select("scan_id", "path", "length", F.sha2("content", 256).alias("content_sha"))


def snapshot_listing(spark, sf):
    """The code files as folders, listed without opening a file."""
    listed = snapshot.snapshot_listing(spark, v.snapshot_folders(spark, sf))
    return listed.select("scan_id", "path", "entry_type", F.when(F.col("entry_type") == "file", F.col("length")).alias("length"))


def line_explode(spark, sf):
    return files.explode_lines(v.code_files(spark, sf))


def line_windows(spark, sf):
    return files.line_windows(v.code_files(spark, sf))


# --- rules ------------------------------------------------------------------------


def _eligible(spark, sf):
    return files.eligible_files(v.code_files(spark, sf))


def rule_query(rule, spark, sf):
    """One rule over every eligible file."""
    hits = match.rule_hits(_eligible(spark, sf), [rule])
    return hits.select("scan_id", "path", "line_no", "text")


def line_findings(spark, sf):
    return flat(match.line_findings(_eligible(spark, sf)))


def window_findings(spark, sf):
    return flat(match.window_findings(_eligible(spark, sf)))


def html_findings(spark, sf):
    return flat(match.source_findings(files.eligible_files(v.html_files(spark, sf))))


def secret_findings(spark, sf):
    """Flagship of the first slice: secrets in all files, redacted and fingerprinted."""
    secrets = [r for r in LINE_RULES if r.id.startswith("SECRET-")]
    return flat(match.line_findings(_eligible(spark, sf), secrets))


# --- dependencies -------------------------------------------------------------------


def dependency_inventory(spark, sf):
    return manifests.dependency_inventory(v.lock_files(spark, sf)).select(
        "scan_id", "file", "ecosystem", "name", "version", "pos"
    )


def advisory_replies(spark, sf):
    return advisories_from_replies(v.advisory_replies(spark, sf))


def baseline_join(spark, sf):
    inventory = manifests.dependency_inventory(v.lock_files(spark, sf))
    return flat(dependencies.baseline_findings(inventory, v.baselines(spark, sf)))


def advisory_join(spark, sf):
    inventory = manifests.dependency_inventory(v.lock_files(spark, sf))
    return flat(dependencies.advisory_findings(inventory, v.advisories(spark, sf)))


def _fallback(spark, sf):
    return dependencies.dependency_findings(
        manifests.dependency_inventory(v.lock_files(spark, sf), npm_limit=None),
        v.advisories(spark, sf),
        v.baselines(spark, sf),
        v.snapshot_list(spark, sf),
    )


def source_fallback(spark, sf):
    return flat(_fallback(spark, sf))


# --- history -------------------------------------------------------------------------


def history_context(spark, sf):
    return history.fill_history_context(v.git_log(spark, sf))


def history_findings(spark, sf):
    return flat(history.history_findings(v.git_log(spark, sf)), "commit")


def history_lines(spark, sf):
    """Documents as logs of several commits each, whole."""
    text = F.concat(
        F.lit("commit:a\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\ncommit:x\n+"))
    )
    logs = v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("scan_id"), text.alias("log")
    )
    return history_log.split_logs(logs)


# --- union, dedup, scores, summaries ---------------------------------------------------


def _own(spark, sf):
    return findings.all_findings(
        match.source_findings(_eligible(spark, sf)),
        history.history_findings(v.git_log(spark, sf)),
    )


def finding_union(spark, sf):
    return flat(_own(spark, sf), "commit")


def finding_dedup(spark, sf):
    unique = findings.dedup_findings(_own(spark, sf))
    at = unique.select("*", F.col("ord.stage").alias("stage"), F.col("ord.n").alias("n"))
    return flat(at, "commit", "stage", "n")


def security_scores(spark, sf):
    unique = findings.dedup_findings(_own(spark, sf))
    scans = v.code_files(spark, sf).select("scan_id").distinct()
    return findings.security_scores(unique, scans)


def severity_counts(spark, sf):
    totals = findings.severity_totals(findings.dedup_findings(_own(spark, sf)))
    return totals.select(
        "scan_id", "total_findings", "critical_total", "high_total", "weight"
    )


def top_findings(spark, sf):
    kept = findings.top_findings(findings.dedup_findings(_own(spark, sf)), TOP_K)
    return kept.select("scan_id", "position", "severity", "rule", "file", "line")


def ranked_findings(spark, sf):
    """Every finding with its position in its snapshot, none cut."""
    ranked = findings.top_findings(durable(findings.dedup_findings(_own(spark, sf))))
    return ranked.select("scan_id", "position", "severity", "rule", "file", "line")


def report_rules(spark, sf):
    """Distinct rules of the stored findings of every snapshot."""
    kept = findings.top_findings(findings.dedup_findings(_own(spark, sf)), findings.MAX_FINDINGS)
    return findings.report_rules(kept).select(
        "scan_id", "rule", "first_position", "title", "explanation", "level"
    )


def severity_breakdown(spark, sf):
    return findings.severity_breakdown(v.order_findings(spark, sf))


def scanner_breakdown(spark, sf):
    return findings.scanner_breakdown(v.order_findings(spark, sf))


def _snapshot_files(spark, sf):
    shared = ["scan_id", "path", "entry_type", "length", "content"]
    return v.code_files(spark, sf).select(shared).unionByName(
        v.lock_files(spark, sf).select(shared)
    )


def _full_scan(spark, sf) -> ScanResult:
    return scan_snapshots(
        v.snapshot_list(spark, sf),
        _snapshot_files(spark, sf),
        v.git_log(spark, sf),
        v.external_reports(spark, sf),
        v.advisories(spark, sf),
        v.baselines(spark, sf),
    )


def _summary_columns(summary):
    return summary.withColumn("scanners", F.array_join("scanners", ", ")).select(
        "scan_id", "score", "open", "resolved", "critical", "high", "files_scanned",
        "bytes_scanned", "skipped_large_files", "truncated", "truncation_reason", "scanners",
        "total_findings", "findings_returned", "findings_truncated",
    )


def scan_summary(spark, sf):
    return _summary_columns(_full_scan(spark, sf).summary)


def full_scan_findings(spark, sf):
    return _full_scan(spark, sf).stored.select(
        "scan_id", "position", "severity", "tool", "rule", "file", "line", "status"
    )


# --- external reports --------------------------------------------------------------------


def semgrep_findings(spark, sf):
    return _external(reports.semgrep_findings(v.external_reports(spark, sf)))


def gitleaks_findings(spark, sf):
    return _external(reports.gitleaks_findings(v.external_reports(spark, sf)))


def osv_report_findings(spark, sf):
    return _external(reports.osv_report_findings(v.external_reports(spark, sf)))


def _external(df):
    return flat(df).drop("fingerprint")


def external_tool_status(spark, sf):
    given = v.external_reports(spark, sf)
    return reports.external_tool_status(given, reports.external_findings(given))


def external_merge(spark, sf):
    """Dependency findings de-duplicated, external ones behind them, scored again."""
    own = findings.dedup_findings(_fallback(spark, sf))
    merged = findings.merge_external(
        own, reports.external_findings(v.external_reports(spark, sf))
    )
    return findings.severity_totals(merged)


# --- comparison and history of scores --------------------------------------------------------


def _pairs(spark, sf):
    return compare.rescan_pairs(v.scans(spark, sf))


def rescan_pairs(spark, sf):
    return _pairs(spark, sf)


def compare_scans(spark, sf):
    return compare.compare_scans(v.scans(spark, sf), v.order_findings(spark, sf))


def _side(op, spark, sf):
    rows = op(_pairs(spark, sf), v.order_findings(spark, sf))
    return rows.select("pair", "key", "rule", "file", "line", "severity")


def compare_snapshots(spark, sf):
    """Comparison of two states of the document snapshots, findings found by the rules."""
    now = match.source_findings(_eligible(spark, sf))
    before = match.source_findings(files.eligible_files(v.code_files_prev(spark, sf)))
    both = durable(
        findings.dedup_findings(now).unionByName(findings.dedup_findings(before))
    )
    ids = v.table(spark, sf, "documents").select(v._doc_scan().alias("scan_id")).distinct()
    earlier = F.concat(F.lit("prev-"), F.col("scan_id"))
    listed = ids.withColumn("previous_scan_id", earlier).unionByName(
        ids.select(earlier.alias("scan_id"), F.lit(None).cast("string").alias("previous_scan_id"))
    )
    scores = findings.security_scores(both, listed)
    return compare.compare_scans(listed.join(scores, "scan_id"), both)


def score_history(spark, sf):
    return compare.score_history(v.scans(spark, sf)).select(
        "url", "scan_id", "score", "score_change"
    )


# --- repositories and archives ------------------------------------------------------------------


def repository_urls(spark, sf):
    parsed = repositories.parse_repository_urls(v.repositories(spark, sf), "url")
    return parsed.select(
        "repo_id", "owner", "repository", "clone_url", "web_url", "reject_reason"
    )


def repository_admission(spark, sf):
    repos = v.repositories(spark, sf)
    reason = repositories.admission_reason(repositories.MAX_REPOSITORY_KB, False)
    return repos.select("repo_id", reason.alias("reject_reason"))


def admitted_repositories(spark, sf):
    return repositories.admit_repositories(v.repositories(spark, sf)).select("repo_id", "size_kb")


ARCHIVE_ENTRIES, ARCHIVE_BYTES = 620, 32_000_000


def archive_guard(spark, sf):
    return archives.guard_archive_entries(
        v.archive_entries(spark, sf), ARCHIVE_ENTRIES, ARCHIVE_BYTES
    ).select("scan_id", "l_orderkey", "l_linenumber", "l_partkey", "entry_type", "size")


def archive_verdicts(spark, sf):
    return archives.archive_verdicts(
        v.archive_entries(spark, sf), ARCHIVE_ENTRIES, ARCHIVE_BYTES
    )


def snapshot_sizes(spark, sf):
    return archives.snapshot_sizes(v.code_files(spark, sf), max_bytes=30_000)


# --- store ------------------------------------------------------------------------------------------


def _rescored(spark, sf):
    """Stored scans, and those that come: some again with another score, others new."""
    old = v.scans(spark, sf).select("scan_id", "url", "created_at", "score")
    again = old.filter(F.col("score") > 50).select(
        F.when(F.col("score") > 75, F.concat(F.lit("n"), F.col("scan_id")))
        .otherwise(F.col("scan_id"))
        .alias("scan_id"),
        "url",
        "created_at",
        (F.col("score") + 1).alias("score"),
    )
    return old, again


def scan_upsert(spark, sf):
    return store.upsert_scans(*_rescored(spark, sf)).select("scan_id", "url", "score")


def stored_upsert(spark, sf):
    """The same in a bucketed store, read back whole."""
    old, again = _rescored(spark, sf)
    held = store.BucketedStore(shared_folder(spark, "store"), buckets=16)
    held.create(old)
    held.upsert(again)
    return held.scans(spark).select("scan_id", "url", "score")


def scan_retention(spark, sf):
    return store.retain_scans(v.scans(spark, sf), NOW, days=400, limit=LISTED).select("scan_id", "url", "score")


def recent_scans(spark, sf):
    return store.recent_scans(v.scans(spark, sf), LISTED).select("scan_id", "url", "score")


def scan_lookup(spark, sf):
    return store.get_scan(v.scans(spark, sf), "117").select("scan_id", "url", "score")


def stored_lookup(spark, sf):
    """A scan by its id from a bucketed store of all scans."""
    held = store.BucketedStore(shared_folder(spark, "store"), buckets=16)
    held.create(v.scans(spark, sf))
    return held.find(spark, "117").select("scan_id", "url", "score")


def scan_list(spark, sf):
    return store.scan_list(v.scans(spark, sf), v.order_findings(spark, sf)).select(
        "scan_id", "url", "score", "finding_count"
    )


def store_metrics(spark, sf):
    return store.store_metrics(v.scans(spark, sf), v.order_findings(spark, sf))


# --- review -------------------------------------------------------------------------------------------


def valid_decisions(spark, sf):
    return review.valid_decisions(v.review_events(spark, sf)).select(
        "event_id", "scan_id", "finding_id", "action"
    )


def _opened(reviewed):
    return reviewed.filter(
        F.col("remediation_pull_request").isNotNull() & (F.col("line") == 1)
    ).select(
        F.lit(-1).cast("long").alias("event_id"),
        "scan_id",
        F.col("id").alias("finding_id"),
        F.col("remediation_pull_request").alias("pull_request"),
        F.lit(NOW).alias("created_at"),
    )


def review_log(spark, sf):
    opened = _opened(v.review_findings(spark, sf))
    return review.review_log(v.review_events(spark, sf), opened).select(
        "event_id", "scan_id", "finding_id", "type", "action", "pull_request"
    )


def _reviewed(spark, sf):
    return review.apply_decisions(v.review_findings(spark, sf), v.review_events(spark, sf))


def apply_decisions(spark, sf):
    return _reviewed(spark, sf).select(
        "scan_id", "finding_key", "status", "decision",
        F.unix_micros("decided_at").alias("decided_us"),
    )


def open_recount(spark, sf):
    return review.open_counts(_reviewed(spark, sf))


def pull_request_findings(spark, sf):
    """Findings after a log in which every purchase opened a pull request for the user's id."""
    events = v.review_events(spark, sf)
    bought = v.table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id")
    opened = events.join(bought, "event_id", "left_semi").select(
        "event_id", "scan_id", "finding_id", "created_at",
        F.concat(F.lit("pr-"), F.col("event_id").cast("string")).alias("pull_request"),
    )
    log = review.review_log(events, opened)
    return review.apply_pull_requests(v.review_findings(spark, sf), log).select(
        "scan_id", "finding_key", "remediation_pull_request"
    )


def remediation_targets(spark, sf):
    candidates = review.remediation_candidates(_reviewed(spark, sf))
    targets = review.remediation_targets(candidates, "decided_at", BRANCH_PREFIX, PLAN_FOLDER)
    return targets.select("scan_id", "id", "finding_key", "branch", "plan_path")


def attach_explanations(spark, sf):
    return review.attach_explanations(
        v.review_findings(spark, sf), v.replies(spark, sf)
    ).select("scan_id", "finding_key", "ai_explanation")


def explanation_prompts(spark, sf):
    return review.explanation_prompts(v.review_findings(spark, sf)).select(
        "scan_id", "finding_key", "prompt"
    )


# --- documents -------------------------------------------------------------------------------------------


def _stored(spark, sf):
    found = findings.dedup_findings(match.source_findings(_eligible(spark, sf)))
    return findings.top_findings(durable(findings.open_findings(found)))


def _doc_scans(spark, sf):
    return v.code_files(spark, sf).select("scan_id").distinct()


def sarif_reports(spark, sf):
    stored = durable(_stored(spark, sf))
    return exports.sarif_documents(_doc_scans(spark, sf), stored, TOOL_NAME)


def json_reports(spark, sf):
    """Nested documents, read back as text fields."""
    stored = durable(_stored(spark, sf))
    docs = exports.json_documents(_doc_scans(spark, sf), stored)
    return docs.select(
        "scan_id",
        F.size("findings").alias("n"),
        F.array_join(
            F.transform("findings", lambda f: F.concat_ws("|", f["id"], f["file"], f["line"])), ";"
        ).alias("ids"),
    )


def sarif_report_parts(spark, sf):
    """SARIF documents as the ordered parts that are written; every finding is a row."""
    return documents.sarif_parts(_doc_scans(spark, sf), durable(_stored(spark, sf)), TOOL_NAME)


def scan_report_parts(spark, sf):
    """Scan documents with repository, findings, summary and comparison."""
    ids = v.scans(spark, sf).select("scan_id")
    order = ("line", "rule", "file", "tool")
    ranked = findings.top_findings(v.order_findings(spark, sf), order=order, distinct=True)
    placed = durable(ranked.join(per_scan(ids), "scan_id", "left_semi"))
    totals = findings.severity_totals(placed)
    told = compare.compare_scans(v.scans(spark, sf), placed).drop("previous_scan_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    summary = F.struct(
        "score", n("total_findings").alias("totalFindings"),
        n("critical_total").alias("critical"), n("high_total").alias("high"),
    )
    comparison = F.when(F.col("score_change").isNotNull(), F.struct(
        F.col("score_change").alias("scoreChange"), F.col("new_findings").alias("newFindings"),
        F.col("fixed_findings").alias("fixedFindings"),
        F.col("unchanged_findings").alias("unchangedFindings"),
    ))
    listed = v.scans(spark, sf).join(totals, "scan_id", "left").join(told, "scan_id", "left").select(
        "scan_id", "created_at", "previous_scan_id",
        F.struct(F.concat(F.lit("c/"), "url").alias("url")).alias("repository"),
        summary.alias("summary"), comparison.alias("comparison"),
    )
    return documents.json_parts(listed, placed, known=True)


def review_report_parts(spark, sf):
    """Scan documents after review, with the event log: seven scans hold everything."""
    reviewed = durable(_reviewed(spark, sf))
    listed = review.open_counts(reviewed).select(
        "scan_id", F.lit("complete").alias("status"), F.struct("open").alias("summary"))
    log = review.review_log(v.review_events(spark, sf), _opened(reviewed))
    return documents.json_parts(listed, findings.top_findings(reviewed), log)


def remediation_plans(spark, sf):
    reviewed = _reviewed(spark, sf)
    scans = reviewed.select("scan_id").distinct().withColumn(
        "commit", F.sha2(F.col("scan_id"), 256)
    )
    docs = exports.remediation_documents(
        scans, reviewed.withColumn("commit", F.lit(None)), TOOL_NAME
    )
    return docs.select("scan_id", "id", F.col("ord.n").alias("n"), "document")


# --- jobs ------------------------------------------------------------------------------------------------


def job_table(spark, sf):
    return jobs.latest_jobs(v.job_events(spark, sf)).select(
        "job_id", "status", "progress", "phase"
    )


def job_stats(spark, sf):
    return jobs.job_stats(v.job_events(spark, sf))


def failed_jobs(spark, sf):
    """Every third failure names no cause; the others' texts have line ends and over 500 characters."""
    text = F.concat(F.col("phase"), F.lit("\r\n\n"), F.repeat(F.lit("x"), (F.col("event_id") % 1000).cast("int")))
    error = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, text)
    return jobs.failed_jobs(v.job_events(spark, sf).withColumn("error", error)).select("job_id", "error")


def live_jobs(spark, sf):
    return jobs.live_jobs(v.job_events(spark, sf), JOB_NOW, "6 hours").select("job_id", "status")


# --- rates and streams -------------------------------------------------------------------------------------

RATE_WINDOW_MS = 6 * 3600 * 1000
RATE_LIMITS = {"scan": 1, "api": 2}


def _stream(spark, sf, name):
    """One of the given tables as a stream."""
    return (
        spark.readStream.schema(v.table(spark, sf, name).schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf)
    )


def rate_verdicts(spark, sf):
    return rates.rate_verdicts(v.request_events(spark, sf), RATE_WINDOW_MS, RATE_LIMITS)


def rate_stream(spark, sf):
    out = shared_folder(spark, "rates")
    arriving = v.to_requests(_stream(spark, sf, "events"))
    rates.rate_stream(
        arriving, f"{out}/rows", f"{out}/progress", RATE_WINDOW_MS, RATE_LIMITS
    ).awaitTermination()
    return sinks.read_batches(spark, f"{out}/rows").drop("batch_id")


def job_stream(spark, sf):
    out = shared_folder(spark, "jobs")
    arriving = v.to_jobs(_stream(spark, sf, "events"))
    jobs.job_stream(arriving, f"{out}/rows", f"{out}/progress").awaitTermination()
    return jobs.latest_jobs(jobs.streamed_jobs(spark, f"{out}/rows")).select(
        "job_id", "status", "progress", "phase"
    )


def live_job_stream(spark, sf):
    """Live jobs at the time of the last event, held as state with timers."""
    out = shared_folder(spark, "live")
    arriving = v.to_jobs(_stream(spark, sf, "events"))
    expiry.live_job_stream(
        arriving, f"{out}/rows", f"{out}/progress", timedelta(hours=6)
    ).awaitTermination()
    return expiry.live_jobs_of(spark, f"{out}/rows").select("job_id", "status", "progress", "phase")


def decision_stream(spark, sf):
    out = shared_folder(spark, "decisions")
    arriving = v.to_reviews(_stream(spark, sf, "events"))
    decisions.decision_stream(arriving, f"{out}/rows", f"{out}/progress").awaitTermination()
    decided = decisions.decided_findings(spark, v.review_findings(spark, sf), f"{out}/rows")
    return decided.select(
        "scan_id", "finding_key", "status", "decision",
        F.unix_micros("decided_at").alias("decided_us"),
    )


def _scanned_stream(spark, sf, notices, files):
    """Snapshots announced in four files, two per batch."""
    out = shared_folder(spark, "scans")
    notices.repartition(4, "scan_id").write.parquet(f"{out}/notices")
    arriving = (
        spark.readStream.schema(notices.schema)
        .option("maxFilesPerTrigger", 2)
        .parquet(f"{out}/notices")
    )

    def tables():
        return scans.SnapshotTables(
            files(spark, sf),
            v.git_log(spark, sf),
            v.external_reports(spark, sf),
            v.advisories(spark, sf),
            v.baselines(spark, sf),
        )

    scans.scan_stream(arriving, tables, f"{out}/store", f"{out}/progress").awaitTermination()
    return scans.current_scans(spark, f"{out}/store")


def scan_stream(spark, sf):
    """Document snapshots alone, as the SQL form has them."""
    notices = v.snapshot_list(spark, sf).filter("history_available")
    return _scanned_stream(spark, sf, notices, v.code_files).select(
        "scan_id", "score", "open", "critical", "high", "files_scanned", "total_findings"
    )


def scan_stream_all(spark, sf):
    """All snapshots with code and lock files; the rows of scan_summary."""
    return _summary_columns(_scanned_stream(spark, sf, v.snapshot_list(spark, sf), _snapshot_files))


def rescan_stream(spark, sf):
    """Document snapshots scanned, scanned again in their later state and compared, in one stream."""
    out = shared_folder(spark, "rescans")
    ids = v.table(spark, sf, "documents").select(v._doc_scan().alias("scan_id")).distinct()
    earlier = F.concat(F.lit("prev-"), F.col("scan_id"))
    no = F.lit(False)

    def announce(rows):
        rows.select(
            "scan_id", "previous_scan_id", no.alias("history_available"),
            no.alias("advisories_available"),
        ).write.mode("append").parquet(f"{out}/notices")
        arriving = spark.readStream.schema(
            "scan_id string, previous_scan_id string, history_available boolean, "
            "advisories_available boolean").parquet(f"{out}/notices")
        scans.scan_stream(arriving, tables, f"{out}/store", f"{out}/progress").awaitTermination()

    def tables():
        shared = ["scan_id", "path", "entry_type", "length", "content"]
        both = v.code_files(spark, sf).select(shared).unionByName(
            v.code_files_prev(spark, sf).select(shared))
        return scans.SnapshotTables(
            both, v.git_log(spark, sf), v.external_reports(spark, sf), v.advisories(spark, sf),
            v.baselines(spark, sf))

    announce(ids.select(earlier.alias("scan_id"), F.lit(None).cast("string").alias("previous_scan_id")))
    announce(ids.withColumn("previous_scan_id", earlier))
    return scans.current_comparisons(spark, f"{out}/store").drop("batch_id")


def registered() -> dict[str, Query]:
    plain: tuple[Query, ...] = (
        snapshot_source, snapshot_listing,
        eligible_files, pruned_directories, file_limit, byte_budget, whole_budget, scan_volume, scanned_files,
        line_explode, line_windows, line_findings, window_findings, html_findings,
        secret_findings, dependency_inventory, advisory_replies, baseline_join, advisory_join, source_fallback,
        history_context, history_findings, history_lines, finding_union, finding_dedup,
        security_scores, severity_counts, top_findings, ranked_findings, report_rules, severity_breakdown,
        scanner_breakdown, scan_summary, full_scan_findings, semgrep_findings, gitleaks_findings,
        osv_report_findings, external_tool_status, external_merge, rescan_pairs, compare_scans,
        compare_snapshots, score_history, repository_urls, repository_admission,
        admitted_repositories, archive_guard, archive_verdicts, snapshot_sizes, scan_upsert, stored_upsert,
        scan_retention, recent_scans, scan_lookup, stored_lookup, scan_list, store_metrics, valid_decisions,
        review_log, apply_decisions, open_recount, pull_request_findings,
        remediation_targets, attach_explanations,
        explanation_prompts, sarif_reports, json_reports, sarif_report_parts, scan_report_parts,
        review_report_parts, remediation_plans, job_table,
        job_stats, failed_jobs, live_jobs, live_job_stream, rate_verdicts, rate_stream, job_stream, decision_stream, scan_stream,
        scan_stream_all, rescan_stream,
    )
    out: dict[str, Query] = {q.__name__: q for q in plain}
    out["new_findings"] = partial(_side, compare.new_findings)
    out["unchanged_findings"] = partial(_side, compare.unchanged_findings)
    out["fixed_findings"] = partial(_side, compare.fixed_findings)
    for rule in RULES:
        out["rule_" + rule.id.lower().replace("-", "_")] = partial(rule_query, rule)
    return out


