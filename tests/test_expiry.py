"""Live jobs held as state against the batch form."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditloom.streaming import expiry, jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "job_id string, status string, progress int, phase string, updated_at timestamp, event_id long"


def event(job, status, minute, event_id, progress=1):
    return (job, status, progress, "p", START + timedelta(minutes=minute), event_id)


def run(spark, tmp_path, batches, idle=60, lateness=0, runs=1):
    """Batches one after the other; the stream is started anew for the last ones."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        arriving = spark.readStream.schema(EVENTS).parquet(str(source))
        expiry.live_job_stream(
            arriving, out, str(tmp_path / "progress"), timedelta(minutes=idle), timedelta(minutes=lateness)
        ).awaitTermination()
    return expiry.live_jobs_of(spark, out)


def rows(df):
    return sorted((r.job_id, r.status, r.event_id) for r in df.collect())


def test_finished_jobs_leave_and_come_again(spark, tmp_path):
    live = run(spark, tmp_path, [
        [event("done", "complete", 0, 1), event("edge", "failed", 40, 2), event("runs", "running", 0, 3),
         event("none", "queued", 0, 4, None), event("back", "complete", 1, 5)],
        [event("tick", "queued", 100, 6)],  # the clock goes to 100 minutes: "edge" is idle for exactly an hour
        [event("back", "running", 101, 7)],
    ])
    assert rows(live) == [
        ("back", "running", 7), ("none", "queued", 4), ("runs", "running", 3), ("tick", "queued", 6)]
    gone = live.sparkSession.read.parquet(str(tmp_path / "out")).filter("not live")
    assert rows(gone) == [("back", "complete", 5), ("done", "complete", 1), ("edge", "failed", 2)]


def test_idle_for_exactly_the_time_stays(spark, tmp_path):
    live = run(spark, tmp_path, [
        [event("edge", "failed", 40, 2), event("over", "failed", 39, 1)], [event("tick", "queued", 100, 6)]])
    assert rows(live) == [("edge", "failed", 2), ("tick", "queued", 6)]


def test_newest_event_counts_and_ties_go_to_the_larger_id(spark, tmp_path):
    live = run(spark, tmp_path, [
        [event("a", "running", 5, 1), event("a", "complete", 5, 2), event("a", "queued", 4, 9)],
        [event("a", "queued", 5, 1), (None, "queued", 1, "p", START, 3), ("b", "queued", 1, "p", None, 4)],
    ], lateness=30)
    assert rows(live) == [("a", "complete", 2)]


@pytest.mark.parametrize("seed", [1])
def test_equals_the_batch_form_at_the_clock(spark, tmp_path, seed):
    rng = random.Random(seed)
    states = ["queued", "running", "complete", "failed"]
    events = [event(f"j{rng.randint(0, 40) if rng.random() < 0.6 else 0}", rng.choice(states),
                    i * 2 + rng.randint(0, 10), i) for i in range(300)]
    live = run(spark, tmp_path, [events[:100], events[100:180], events[180:]], lateness=30)
    whole = spark.createDataFrame(events, EVENTS)
    clock = whole.agg(F.max("updated_at")).first()[0] - timedelta(minutes=30)
    assert rows(live) == rows(jobs.live_jobs(whole, clock.replace(tzinfo=timezone.utc)))
