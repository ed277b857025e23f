"""Streams whose batches are folded into generations."""

from datetime import datetime, timedelta, timezone

import pytest

from auditloom import schemas
from auditloom.operators.dependencies import default_baselines
from auditloom.operators.review import latest_decisions
from auditloom.streaming import decisions, jobs, scans, sinks
from tests.helpers import files_table

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


def arriving(spark, folder, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def folders(df):
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}


def test_job_batches_are_folded(spark, tmp_path):
    events = [
        (i, f"j{i % 3}", "running" if i < 5 else "complete", i, f"p{i}", at(100 - i if i % 2 else i)) for i in range(8)
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = arriving(spark, source, schemas.JOB_EVENTS, [[e] for e in events])
    jobs.job_stream(stream, out, str(tmp_path / "cp"), fold_every=3).awaitTermination()
    assert sinks.newest_generation(spark, out) == 5 and sinks.newest_generation(spark, out, 5) == 2
    held = jobs.streamed_jobs(spark, out)
    assert folders(held) == {"upto=5", "batch_id=6", "batch_id=7"}
    want = jobs.latest_jobs(spark.createDataFrame(events, schemas.JOB_EVENTS))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(jobs.latest_jobs(held)) == key(want)
    assert sinks.read_batches(spark, out).select("batch_id").distinct().count() == 8  # the log stays


def test_a_broken_generation_is_passed_by_and_made_again(spark, tmp_path):
    out = str(tmp_path / "out")
    for n in range(3):
        sinks.write_batch(spark.range(n, n + 1), out, n)
    sinks.fold_batches(spark, out, 2, lambda held: held, every=3)
    (tmp_path / "out" / sinks.GENERATIONS / "upto=2" / "_SUCCESS").unlink()
    assert sinks.newest_generation(spark, out) is None
    assert sorted(r.id for r in sinks.read_since(spark, out, None).collect()) == [0, 1, 2]
    sinks.fold_batches(spark, out, 2, lambda held: held, every=3)
    assert sinks.newest_generation(spark, out) == 2
    held = sinks.read_since(spark, out, 2)
    assert sorted((r.id, r.batch_id) for r in held.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert folders(held) == {"upto=2"}


def test_decisions_survive_folding(spark, tmp_path):
    batches = [
        [(1, "s", "a", "approve", at(9)), (2, "s", "b", "reject", at(0))],
        [(3, "s", "a", "reject", at(1)), (4, "t", "a", "approve", at(1))],  # late for s
        [(2, "s", "b", "reject", at(0)), (5, "s", "b", "approve", at(0))],  # a repeat, and a tie in time
        [(6, "s", "c", "odd", at(3)), (7, "s", "c", "reject", at(2))],
        [(8, "t", "a", "reject", None)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = arriving(spark, source, schemas.REVIEW_EVENTS, batches)
    decisions.decision_stream(stream, out, str(tmp_path / "cp"), fold_every=2).awaitTermination()
    last = sinks.newest_generation(spark, out)
    assert last == 3
    held = sinks.read_since(spark, out, last)
    assert folders(held) == {"upto=3", "batch_id=4"}
    want = latest_decisions(spark.createDataFrame(sum(batches, []), schemas.REVIEW_EVENTS))
    key = lambda df: sorted((r.scan_id, r.finding_id, r.action, r.decided_at) for r in df.collect())
    assert key(latest_decisions(held)) == key(want)
    logged = sinks.read_batches(spark, out)
    assert {r.event_id for r in logged.collect()} == {1, 2, 3, 4, 5, 7, 8}


NOTICE = "scan_id string, previous_scan_id string, history_available boolean, advisories_available boolean"


@pytest.mark.parametrize("every", [2])
def test_scans_are_folded_with_their_findings(spark, tmp_path, every):
    rows = [("a", "x.js", "eval(1)\neval(b)"), ("b", "x.js", "eval(1)"), ("c", "y.js", "eval(3)"), ("d", "z.js", "1")]
    tables = scans.SnapshotTables(
        files_table(spark, rows),
        spark.createDataFrame([], schemas.GIT_LOG),
        spark.createDataFrame([], schemas.EXTERNAL_REPORTS),
        spark.createDataFrame([], schemas.ADVISORIES),
        default_baselines(spark),
    )
    named = [[("a", None)], [("b", "a"), ("d", "lost")], [("a", "b")], [("c", "b")], [("d", "a")]]
    batches = [[(i, p, False, False) for i, p in batch] for batch in named]
    stores = []
    for name, fold in (("folded", every), ("plain", 100)):
        stream = arriving(spark, str(tmp_path / name / "in"), NOTICE, batches)
        stores.append(str(tmp_path / name / "out"))
        scans.scan_stream(
            stream, lambda: tables, stores[-1], str(tmp_path / name / "cp"), fold_every=fold
        ).awaitTermination()
    folded, plain = stores
    assert sinks.newest_generation(spark, f"{folded}/scans") == 3
    assert sinks.newest_generation(spark, f"{plain}/scans") is None
    assert folders(sinks.read_since(spark, f"{folded}/findings", 3)) <= {"upto=3", "batch_id=4"}
    for part, columns in (
        (scans.current_scans, ["scan_id", "batch_id", "score", "open"]),
        (scans.current_findings, ["scan_id", "batch_id", "rule", "line"]),
        (scans.current_comparisons, ["scan_id", "previous_scan_id", "new_findings", "fixed_findings"]),
    ):
        key = lambda out: sorted(map(tuple, part(spark, out).select(columns).collect()))  # noqa: B023,E731
        assert key(folded) == key(plain) != []
