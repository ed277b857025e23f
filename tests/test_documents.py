"""Documents written as parts against the documents held in one value."""

import json
from collections import defaultdict
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import functions as F

from auditloom.sources import documents, exports

AT = datetime(2024, 5, 1, 12, 30, 15, 250_000, tzinfo=timezone.utc)
FOUND = (
    "scan_id string, position int, id string, severity string, title string, tool string, rule string, "
    "file string, line int, explanation string, evidence string, patch array<string>, status string, "
    "decision string, commit string, fingerprint string, decided_at timestamp, ai_explanation string, "
    "remediation_pull_request string"
)


def finding(scan, position, rule="R", title="T", severity="high"):
    return (scan, position, f"{rule}-{position}", severity, title, "Source scan", rule, 'a"b\\c.js', position,
            "why\nnot   é", f"line {position}\t\x01", ["- a", "+ b"], "open", None, None, None,
            AT if position == 1 else None, None, None)


def scans(spark):
    return spark.createDataFrame(
        [("s/1", AT, None, ("o", 5), (90,)), ("none", AT, "s/1", ("p", None), None)],
        "scan_id string, created_at timestamp, previous_scan_id string, "
        "repository struct<owner: string, sizeKb: int>, summary struct<score: int>",
    )


def texts(path):
    """Documents by scan: files by name, parts by line."""
    out = defaultdict(str)
    for folder in Path(path).glob("scan_id=*"):
        for file in sorted(folder.glob("part-*")):
            out[unquote(folder.name.removeprefix("scan_id="))] += file.read_text(encoding="utf-8")
    return out


def test_json_document_of_many_files(spark, tmp_path):
    rows = [finding("s/1", n + 1) for n in range(500)] + [finding("other", 1)]
    found = spark.createDataFrame(rows, FOUND).repartition(7, "line")
    events = spark.createDataFrame(
        [("s/1", e, "finding_decision", f"R-{e}", "approve", None, AT) for e in (3, 1, 2)],
        "scan_id string, event_id long, type string, finding_id string, action string, "
        "pull_request string, created_at timestamp",
    )
    documents.write_documents(documents.json_parts(scans(spark), found, events), str(tmp_path / "d"), 9)
    assert len(list((tmp_path / "d" / "scan_id=s%2F1").glob("part-*"))) > 3
    read = {k: json.loads(t) for k, t in texts(tmp_path / "d").items()}
    assert set(read) == {"s/1", "none"}  # a finding without its scan belongs to no document
    whole = read["s/1"]
    assert list(whole) == ["id", "createdAt", "previousScanId", "repository", "findings", "events", "summary"]
    assert whole["createdAt"] == "2024-05-01T12:30:15.250Z"
    assert whole["repository"] == {"owner": "o", "sizeKb": 5}
    assert [f["line"] for f in whole["findings"]] == list(range(1, 501))
    first = whole["findings"][0]
    assert first["file"] == 'a"b\\c.js' and first["explanation"] == "why\nnot   é"
    assert first["evidence"] == "line 1\t\x01" and first["patch"] == ["- a", "+ b"]
    assert first["decidedAt"] == "2024-05-01T12:30:15.250Z" and first["decision"] is None
    assert [e["findingId"] for e in whole["events"]] == ["R-1", "R-2", "R-3"]
    assert read["none"]["findings"] == [] and read["none"]["events"] == []
    assert read["none"]["summary"] is None and read["none"]["previousScanId"] == "s/1"


def test_json_document_without_closing_fields(spark):
    only = scans(spark).select("scan_id")
    found = spark.createDataFrame([], FOUND)
    rows = documents.json_parts(only, found).orderBy(*documents.PART_ORDER).collect()
    text = "".join(r.text for r in rows if r.scan_id == "none")
    assert json.loads(text) == {"id": "none", "findings": []}


def test_sarif_parts_equal_the_document(spark, tmp_path):
    rows = [finding("s/1", n + 1, f"R{n % 3}", f"T{n}", ("low", "high", "medium")[n % 3]) for n in range(200)]
    found = spark.createDataFrame(rows, FOUND)
    documents.write_documents(documents.sarif_parts(scans(spark), found, "Tool"), str(tmp_path / "d"), 5)
    written = texts(tmp_path / "d")
    nested = exports.sarif_documents(scans(spark), found, "Tool").collect()
    assert {r.scan_id: r.sarif for r in nested} == {k: t.replace("\n", "") for k, t in written.items()}


def test_parts_stay_small_for_a_hot_scan(spark):
    found = spark.range(200_000).select(
        F.lit("s/1").alias("scan_id"), (F.col("id") + 1).cast("int").alias("position"), F.lit("R").alias("rule"))
    parts = documents.json_parts(scans(spark), found)
    assert parts.agg(F.max(F.length("text"))).first()[0] < 300
    assert parts.filter("section = 1").count() == 200_000
