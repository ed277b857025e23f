"""Decisions, comparison and documents."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tests.helpers import scan
from auditloom import schemas
from auditloom.operators import compare, review
from auditloom.sources import exports

FINDING = (
    f"scan_id string, ord {schemas.ORD}, id string, finding_key string, severity string, "
    "title string, rule string, file string, line int, explanation string, evidence string, "
    "patch array<string>, status string, decision string, decided_at timestamp, commit string, "
    "fingerprint string, ai_explanation string, remediation_pull_request string"
)


def finding(spark, *rows):
    """Rows of (id, key) or dicts of column values."""
    full = []
    for n, given in enumerate(rows):
        row = {
            "scan_id": "s", "ord": (0, "", 1, n, 0, ""), "severity": "high", "title": "t",
            "rule": "R", "file": "a.js", "line": n, "patch": [], "status": "open",
            "finding_key": f"k{n}", "evidence": "e",
        } | given
        full.append(tuple(row.get(c.split()[0]) for c in FIELDS))
    return spark.createDataFrame(full, FINDING)


FIELDS = [
    "scan_id", "ord", "id", "finding_key", "severity", "title", "rule", "file", "line",
    "explanation", "evidence", "patch", "status", "decision", "decided_at", "commit",
    "fingerprint", "ai_explanation", "remediation_pull_request",
]


def event(n, finding_id, action, second=0):
    at = datetime(2024, 1, 1, 0, 0, second, tzinfo=timezone.utc)
    return (n, "s", finding_id, action, at)


def decide(spark, findings, *events):
    return review.apply_decisions(
        findings, spark.createDataFrame(list(events), schemas.REVIEW_EVENTS)
    )


def test_two_decisions_on_one_scan_both_survive(spark):
    found = finding(spark, {"id": "a"}, {"id": "b"})
    rows = decide(spark, found, event(1, "a", "approve"), event(2, "b", "reject")).collect()
    assert {r.id: r.status for r in rows} == {"a": "approved", "b": "dismissed"}


def test_the_latest_valid_decision_wins_and_only_the_first_bearer_changes(spark):
    found = finding(spark, {"id": "a"}, {"id": "a"}, {"id": "c", "finding_key": "k0"})
    done = decide(
        spark, found, event(3, "a", "reject", 5), event(2, "a", "approve", 1),
        event(4, "a", "later", 9), event(5, "zz", "approve"),
    )
    rows = sorted(done.collect(), key=lambda r: r.ord.n)
    assert [r.status for r in rows] == ["dismissed", "open", "open"]
    assert rows[0].decision == "reject" and rows[0].decided_at is not None
    assert review.open_counts(done).first().open == 2


def test_remediation_candidates(spark):
    found = finding(
        spark, {"id": "a", "decision": "approve"}, {"id": "a", "decision": "approve"},
        {"id": "b", "decision": "approve", "remediation_pull_request": "x"},
        {"id": "c", "decision": "reject"},
    )
    rows = review.remediation_candidates(found).collect()
    assert [(r.id, r.finding_key) for r in rows] == [("a", "k0")]


def test_explanations_go_to_the_first_bearer(spark):
    found = finding(spark, {"id": "a", "ai_explanation": "old"}, {"id": "b"}, {"id": "b"})
    replies = spark.createDataFrame(
        [("s", "a", "2024-01-01", "<i></i>"), ("s", "b", "2024-01-01", "zz older"),
         ("s", "b", "2024-01-02", " new "), ("s", "b", "2024-01-03", None)],
        "scan_id string, finding_id string, created_at string, reply string",
    )
    rows = sorted(review.attach_explanations(found, replies).collect(), key=lambda r: r.ord.n)
    assert [r.ai_explanation for r in rows] == ["old", "new", None]


def test_remediation_document_escapes_and_indents(spark):
    found = finding(
        spark,
        {"id": "finding", "title": "Unsafe <script>", "explanation": "Review",
         "evidence": "```\n# injected", "patch": ["```", "[click](javascript:alert(1))"]},
    )
    scans = spark.createDataFrame([("s", "abc")], "scan_id string, commit string")
    text = exports.remediation_documents(scans, found, "Tool").first().document
    assert "Unsafe &lt;script&gt;" in text and "    ```\n    # injected" in text
    assert "- Repository commit: abc\n" in text and "\n```" not in text
    assert text.startswith("# Tool remediation plan\n\n- Scan: s\n") and text.endswith("code.\n")


def test_sarif_and_json_documents(spark, tmp_path):
    rows = [("s", "a.js", "eval(1)\nrejectUnauthorized: false\neval(2)"), ("t", "b.js", "x")]
    result = scan(spark, rows)
    scans = spark.createDataFrame([("s",), ("t",)], "scan_id string")
    docs = {
        r.scan_id: json.loads(r.sarif)
        for r in exports.sarif_documents(scans, result.stored, "Tool").collect()
    }
    run = docs["s"]["runs"][0]
    assert docs["s"]["version"] == "2.1.0" and "sarif-2.1.0" in docs["s"]["$schema"]
    assert run["tool"]["driver"]["name"] == "Tool"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC-EVAL", "SEC-TLS"]
    lines = [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]]
    assert lines == [1, 3, 2] and [r["level"] for r in run["results"]][-1] == "warning"
    assert docs["t"]["runs"][0]["results"] == []
    exports.export_json(scans, result.stored, str(tmp_path / "j"))
    exports.export_sarif(scans, result.stored, "Tool", str(tmp_path / "s"))
    stored = {r.scan_id: r for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert [f.line for f in stored["s"].findings] == [1, 3, 2] and stored["t"].findings == []
    assert spark.read.text(str(tmp_path / "s")).count() == 2


def test_comparison_counts_rows_and_falls_back_to_the_place(spark):
    def row(scan_id, fp, line=1):
        return {"scan_id": scan_id, "id": "x", "fingerprint": fp, "line": line}

    found = finding(
        spark,
        row("old", "f1"), row("old", "gone"), row("old", "gone", 2), row("old", None, 7),
        row("new", "f1"), row("new", "f1", 2), row("new", "", 7), row("new", "n1"),
        row("lone", "f1"),
    )
    scans = spark.createDataFrame(
        [("old", None, 40), ("new", "old", 70), ("lone", "missing", 1)],
        "scan_id string, previous_scan_id string, score int",
    )
    rows = compare.compare_scans(scans, found).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.scan_id, r.score_change) == ("new", 30)
    assert (r.new_findings, r.fixed_findings, r.unchanged_findings) == (1, 2, 3)
    pairs = compare.rescan_pairs(scans)
    assert compare.new_findings(pairs, found).count() == 1
    assert compare.fixed_findings(pairs, found).count() == 2
    assert compare.unchanged_findings(pairs, found).count() == 3


def test_comparison_of_a_scan_without_findings(spark):
    found = finding(spark, {"scan_id": "a", "id": "x", "fingerprint": "f"})
    scans = spark.createDataFrame(
        [("a", None, 86), ("b", "a", 100)], "scan_id string, previous_scan_id string, score int"
    )
    r = compare.compare_scans(scans, found).first()
    assert (r.new_findings, r.fixed_findings, r.unchanged_findings) == (0, 1, 0)


def test_review_log_keeps_both_kinds_of_events(spark):
    events = spark.createDataFrame(
        [event(1, "a", "approve"), event(2, "a", "x")], schemas.REVIEW_EVENTS
    )
    opened = events.filter("event_id = 2").withColumn("pull_request", F.lit("pr"))
    kinds = {r.type for r in review.review_log(events, opened).collect()}
    assert kinds == {"finding_decision", "remediation_pull_request"}


def test_newest_pull_request_goes_to_the_first_bearer(spark):
    found = finding(spark, {"id": "a"}, {"id": "b"}, {"id": "b"})
    opened = spark.createDataFrame(
        [(1, "s", "b", "pr1", "2024-01-01"), (2, "s", "b", "pr2", "2024-01-02"), (3, "s", "x", "pr3", "2024-01-03")],
        "event_id long, scan_id string, finding_id string, pull_request string, created_at string",
    )
    log = opened.selectExpr("*", "'remediation_pull_request' as type", "cast(null as string) as action")
    other = log.withColumn("type", F.lit("finding_decision"))
    rows = review.apply_pull_requests(found, log.unionByName(other)).collect()
    kept = [r.remediation_pull_request for r in sorted(rows, key=lambda r: r.ord.n)]
    assert kept == [None, "pr2", None]
