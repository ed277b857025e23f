"""Live jobs as keyed state: a finished job leaves the state once it has been idle for long."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditloom.streaming.jobs import FINAL_STATES
from auditloom.streaming.sinks import ONCE, read_batches, write_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JOB = "job_id string, status string, progress int, phase string, updated_us long, event_id long"
HELD = JOB.removeprefix("job_id string, ")
CHANGE = JOB + ", live boolean"


def _newest(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["updated_us", "event_id"]).drop_duplicates("job_id", keep="last")


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest event per job of each Arrow batch, so that a hot job is reduced before the shuffle."""
    for frame in frames:
        yield _newest(frame)


class _LiveJobs(StatefulProcessor):
    """Holds the newest event per job, and a timer for a finished one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _expiry(self, held) -> int:
        """First millisecond at which the event is idle for more than ``idle_ms``."""
        return held[3] // 1000 + self.idle_ms + 1

    def handleInputRows(self, key, rows, timerValues):
        best, before = None, self.held.get() if self.held.exists() else None
        for frame in rows:
            row = _newest(frame).iloc[0]
            event = (row.status, None if pd.isna(row.progress) else int(row.progress), row.phase,
                     int(row.updated_us), int(row.event_id))
            if best is None or event[3:] > best[3:]:
                best = event
        if best is None or (before is not None and tuple(before)[3:] >= best[3:]):
            return
        if before is not None and before[0] in FINAL_STATES:
            self.handle.deleteTimer(self._expiry(before))
        self.held.update(best)
        if best[0] in FINAL_STATES:
            self.handle.registerTimer(self._expiry(best))
        yield self._change(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.held.exists():
            return
        held = tuple(self.held.get())
        if held[0] in FINAL_STATES and self._expiry(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._change(key, held, False)

    def close(self) -> None:
        pass

    @staticmethod
    def _change(key, held, live: bool) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *held, live)], columns=[f.split()[0] for f in CHANGE.split(", ")])
        return frame.astype({"progress": "Int32"})


def live_job_stream(
    job_events: DataFrame,
    out: str,
    checkpoint: str,
    idle: timedelta = timedelta(hours=1),
    lateness: timedelta = timedelta(0),
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Writes the changes of the live jobs, batch by batch.

    A job is held with its newest event. The clock is the watermark: the newest ``updated_at`` of the
    batches before, less ``lateness``. A finished job whose event is older than the clock by more than
    ``idle`` leaves the state, so the state holds unfinished and recently finished jobs alone. Events
    older than the clock come too late: they are dropped, as for a job that has left they could not be
    told from a new one. Events without a job or time have no place and are dropped too.
    """
    spark = job_events.sparkSession
    usable = job_events.filter(F.col("job_id").isNotNull() & F.col("updated_at").isNotNull()).select(
        "job_id", "status", F.col("progress").cast("int").alias("progress"), "phase",
        F.unix_micros("updated_at").alias("updated_us"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"),
    )
    timed = (
        usable.mapInPandas(_reduced, JOB)
        .withColumn("updated_at", F.timestamp_micros("updated_us"))
        .withWatermark("updated_at", f"{int(lateness.total_seconds() * 1000)} milliseconds")
    )
    changes = timed.groupBy("job_id").transformWithStateInPandas(
        _LiveJobs(int(idle.total_seconds() * 1000)), CHANGE, "Update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, batch_id)

    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)  # state with timers needs it; the query keeps it when it has started
    try:
        return (
            changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(**trigger)
            .start()
        )
    finally:
        spark.conf.unset(PROVIDER) if held is None else spark.conf.set(PROVIDER, held)


def live_jobs_of(spark: SparkSession, out: str) -> DataFrame:
    """The live jobs after the last batch: the last change of each job, if it has not left."""
    fields = ("status", "progress", "phase", "updated_us", "event_id", "live")
    last = F.struct("batch_id", "updated_us", "event_id", (~F.col("live")).alias("gone"))
    return (
        read_batches(spark, out)
        .groupBy("job_id")
        .agg(F.max_by(F.struct(*fields), last).alias("_now"))
        .select("job_id", "_now.*")
        .filter("live")
        .select("job_id", "status", "progress", "phase",
                F.timestamp_micros("updated_us").alias("updated_at"), "event_id")
    )
