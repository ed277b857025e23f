"""Streams against their batch twins."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from auditloom import schemas
from auditloom.operators.dependencies import default_baselines
from auditloom.operators.review import latest_decisions
from auditloom.plans.scan import scan_snapshots
from auditloom.streaming import decisions, jobs, rates, scans, sinks
from tests.helpers import files_table
from workload import views
from workload.queries import registered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests(spark, rows):
    """Rows (event_id, client, category, milliseconds)."""
    full = [(e, c, k, START + timedelta(milliseconds=t)) for e, c, k, t in rows]
    return spark.createDataFrame(full, schemas.REQUEST_EVENTS)


def sequential(rows, window, limits):
    """One request after the other."""
    state, out = {}, {}
    for e, c, k, t in sorted(rows, key=lambda r: (r[3], r[0])):
        start, n = state.get((c, k), (None, 0))
        if start is None or t - start > window:
            start, n = t, 0
        state[(c, k)] = (start, n + 1)
        out[e] = (start, n + 1, n + 1 <= limits[k])
    return out


def verdicts(df):
    zero = int(START.timestamp() * 1000)
    return {r.event_id: (r.window_start - zero, r.position, r.allowed) for r in df.collect()}


def random_requests(seed):
    rnd, rows = random.Random(seed), []
    for c in range(10):
        t = rnd.randrange(10_000)
        for _ in range(rnd.choice([1, 4, 60, 300])):
            t += rnd.choice([0, 1, 30, 59, 60, 61, 700, 9000] if c % 2 else [0, 1, 2, 30])
            rows.append((len(rows), f"c{c}", "scan" if c % 3 else "api", t))
    return rows


@pytest.mark.parametrize("per_batch", ["9", "10000"])
def test_rate_verdicts_equal_a_sequential_walk(spark, per_batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, per_batch)
    rows = random_requests(7)
    want = sequential(rows, 60, rates.LIMITS)
    for blocks in (1, 3):
        assert verdicts(rates.rate_verdicts(requests(spark, rows), 60, block_windows=blocks)) == want
    spark.conf.set(name, usual)


def test_rate_window_edge(spark):
    rows = [(1, "c", "scan", 0), (2, "c", "scan", 60_000), (3, "c", "scan", 60_001)]
    got = verdicts(rates.rate_verdicts(requests(spark, rows)))
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (60_001, 1, True)}


def test_refused_requests_count(spark):
    rows = [(i, "c", "scan", i) for i in range(8)]
    got = verdicts(rates.rate_verdicts(requests(spark, rows)))
    assert [got[i][2] for i in range(8)] == [True] * 6 + [False] * 2


def test_rate_stream(spark, tmp_path):
    rows = sorted(random_requests(8), key=lambda r: r[3])
    source = str(tmp_path / "in")
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        requests(spark, part).coalesce(1).write.mode("append").parquet(source)
    arriving = (
        spark.readStream.schema(schemas.REQUEST_EVENTS).option("maxFilesPerTrigger", 1)
        .parquet(source)
    )
    rates.rate_stream(
        arriving, str(tmp_path / "out"), str(tmp_path / "cp"), 60
    ).awaitTermination()
    got = verdicts(sinks.read_batches(spark, str(tmp_path / "out")))
    assert got == sequential(rows, 60, rates.LIMITS)


def test_late_requests_get_verdicts(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([(1, "a", "scan", 900_000)], [(2, "b", "scan", 0)], [(3, "a", "scan", 5), (4, "d", "scan", 1)]):
        requests(spark, part).coalesce(1).write.mode("append").parquet(source)
    arriving = (
        spark.readStream.schema(schemas.REQUEST_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    )
    rates.rate_stream(arriving, str(tmp_path / "out"), str(tmp_path / "cp"), 60).awaitTermination()
    got = sinks.read_batches(spark, str(tmp_path / "out")).select("event_id").collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4]


def test_job_stream_and_expiry(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [
        (1, "a", "queued", 5, "w", at(0)), (2, "a", "complete", 100, "done\nnow", at(1)),
        (3, "b", "running", 12, "r", at(1)), (4, "c", "failed", 100, "f", at(2)),
    ]
    source = str(tmp_path / "in")
    for part in (rows[2:], rows[:2]):
        spark.createDataFrame(part, schemas.JOB_EVENTS).coalesce(1).write.mode("append").parquet(source)
    arriving = (
        spark.readStream.schema(schemas.JOB_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    )
    jobs.job_stream(arriving, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    held = jobs.streamed_jobs(spark, str(tmp_path / "out"))
    assert {r.phase for r in jobs.latest_jobs(held).collect()} == {"done\nnow", "r", "f"}
    stats = jobs.job_stats(held).first()
    assert (stats.active, stats.queued, stats.completed, stats.failed) == (1, 0, 1, 1)
    # An hour after job a ended it is still there; a moment later it is not.
    assert {r.job_id for r in jobs.live_jobs(held, at(61)).collect()} == {"a", "b", "c"}
    later = at(61) + timedelta(seconds=1)
    assert {r.job_id for r in jobs.live_jobs(held, later).collect()} == {"b", "c"}


def test_failure_texts(spark):
    at = START + timedelta(minutes=1)
    rows = [("a", "failed", at, 1, "bad\r\n\nday"), ("b", "failed", at, 1, ""), ("c", "failed", at, 1, None),
            ("d", "failed", at, 1, "x" * 600), ("e", "failed", START, 1, "old"), ("e", "queued", at, 2, None)]
    table = spark.createDataFrame(
        rows, "job_id string, status string, updated_at timestamp, event_id long, error string")
    got = {r.job_id: r.error for r in jobs.failed_jobs(table).collect()}
    assert got == {"a": "bad day", "b": "Scan failed", "c": "Scan failed", "d": "x" * 500}


def test_decision_stream_keeps_late_decisions(spark, tmp_path):
    rows = [
        (1, "s", "a", "approve", START), (2, "s", "b", "reject", START), (3, "s", "a", "odd", START),
        (4, "s", "c", "approve", START - timedelta(days=2)),
    ]
    source = str(tmp_path / "in")
    for part in (rows[:3], rows[:1], rows[3:]):
        spark.createDataFrame(part, schemas.REVIEW_EVENTS).coalesce(1).write.mode("append").parquet(source)
    arriving = (
        spark.readStream.schema(schemas.REVIEW_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    )
    decisions.decision_stream(arriving, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    logged = sinks.read_batches(spark, str(tmp_path / "out"))
    assert {r.event_id for r in logged.collect()} == {1, 2, 4}
    latest = latest_decisions(logged).collect()
    assert sorted((r.finding_id, r.action) for r in latest) == [
        ("a", "approve"), ("b", "reject"), ("c", "approve")]


NOTICE = "scan_id string, history_available boolean, advisories_available boolean"


def test_scan_stream_equals_the_batch_scan_and_replaces_rescans(spark, tmp_path):
    lock = json.dumps({"packages": {"node_modules/lodash": {"version": "1.0"}}})
    rows = [
        ("a", "x.js", "eval(1)"), ("a", "package-lock.json", lock), ("b", "y.js", "eval(2)\neval(3)"),
        ("c", "z.js", "nothing"),
    ]
    tables = scans.SnapshotTables(
        files_table(spark, rows),
        spark.createDataFrame([], schemas.GIT_LOG),
        spark.createDataFrame([], schemas.EXTERNAL_REPORTS),
        spark.createDataFrame([], schemas.ADVISORIES),
        default_baselines(spark),
    )
    source = str(tmp_path / "in")
    for ids in (["a", "b"], ["c", "a"]):
        spark.createDataFrame([(i, False, False) for i in ids], NOTICE).coalesce(1).write.mode(
            "append"
        ).parquet(source)
    arriving = spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    scans.scan_stream(arriving, lambda: tables, out, str(tmp_path / "cp")).awaitTermination()
    listed = spark.createDataFrame([(i, False, False) for i in "abc"], NOTICE)
    batch = scan_snapshots(
        listed, tables.files, tables.git_log, tables.reports, tables.advisories, tables.baselines
    )
    key = lambda df: sorted((r.scan_id, r.score, r.total_findings) for r in df.collect())
    assert key(scans.current_scans(spark, out)) == key(batch.summary)
    found = lambda df: sorted((r.scan_id, r.rule, r.line) for r in df.collect())
    assert found(scans.current_findings(spark, out)) == found(batch.stored)


def test_scan_stream_compares_with_what_earlier_batches_stored(spark, tmp_path):
    rows = [
        ("a1", "x.js", "eval(1)\neval(other)"), ("a2", "x.js", "eval(1)\n"), ("a2", "y.js", "eval(2)"),
        ("a3", "y.js", "eval(2)"), ("lost", "x.js", "eval(1)"), ("clean", "x.js", "1"),
    ]
    tables = scans.SnapshotTables(
        files_table(spark, rows),
        spark.createDataFrame([], schemas.GIT_LOG),
        spark.createDataFrame([], schemas.EXTERNAL_REPORTS),
        spark.createDataFrame([], schemas.ADVISORIES),
        default_baselines(spark),
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "scan_id string, previous_scan_id string, history_available boolean, advisories_available boolean"

    def announce(*pairs):
        spark.createDataFrame([(i, p, False, False) for i, p in pairs], schema).coalesce(1).write.mode(
            "append").parquet(source)

    def run(checkpoint):
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        scans.scan_stream(arriving, lambda: tables, out, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(
            (r.scan_id, r.previous_scan_id, r.new_findings, r.fixed_findings, r.unchanged_findings, r.score_change)
            for r in scans.current_comparisons(spark, out).collect())

    announce(("a1", None), ("lost", "never stored"))
    assert run("first") == []
    announce(("a2", "a1"), ("a3", "a2"))  # one compared with a stored scan, one with its own batch
    announce(("clean", "a2"))
    weight = 25 if spark.read.parquet(f"{out}/findings").first().severity == "critical" else 14
    want = [("a2", "a1", 1, 1, 1, 0), ("a3", "a2", 0, 1, 1, weight), ("clean", "a2", 0, 2, 0, 2 * weight)]
    assert run("first") == want
    assert run("anew") == want  # every batch again, over what is stored by now


def test_scan_stream_of_all_snapshots_has_the_rows_of_the_batch_scan(spark):
    sf = "/root/testdata/sf0.001"
    streamed = registered()["scan_stream_all"](spark, sf)
    rows = sorted(map(tuple, streamed.collect()))
    assert rows == sorted(map(tuple, registered()["scan_summary"](spark, sf).select(streamed.columns).collect()))
    assert len(rows) == views.snapshot_list(spark, sf).count()


@pytest.mark.parametrize("most", [2, 1])
def test_tables_of_a_batch_broadcast_no_ids(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "PRUNED_IDS", most)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "scan_id string, n int")
    announced = spark.createDataFrame([("a",), ("b",)], "scan_id string")
    own = scans.SnapshotTables(rows, rows, rows, rows, rows).of(announced)
    for part in (own.files, own.git_log, own.reports):
        assert sorted(r.n for r in part.collect()) == [1, 2, 3]
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
    assert own.advisories.count() == 5
