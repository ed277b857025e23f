"""Job status tables, in batch and as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from auditloom.functions import text as tx
from auditloom.streaming.sinks import (
    FOLD_EVERY,
    ONCE,
    fold_batches,
    newest_generation,
    read_since,
    write_batch,
)

JOB_IDLE = "1 hour"

# States of a job; the last two are final.
QUEUED, RUNNING, COMPLETE, FAILED = "queued", "running", "complete", "failed"
FINAL_STATES = (COMPLETE, FAILED)
NO_ERROR = "Scan failed"  # fixed value: the text of a failure that names no cause
JOB_FIELDS = ("status", "progress", "phase", "updated_at", "event_id")


def latest_jobs(job_events: DataFrame) -> DataFrame:
    """Newest status, progress and phase of each job, the phase as it was sent."""
    newest = F.struct("updated_at", "event_id")
    return (
        job_events.groupBy("job_id")
        .agg(F.max_by(F.struct(*JOB_FIELDS), newest).alias("_now"))
        .select("job_id", "_now.*")
    )


def failed_jobs(job_events: DataFrame) -> DataFrame:
    """Failed jobs with the text of their failure on one line.

    ``job_events`` also has error; an event without one, or with an empty one, bears the fixed text.
    """
    told = F.when(F.col("error") == "", None).otherwise(F.col("error"))
    newest = F.struct("updated_at", "event_id")
    fields = F.struct("status", "updated_at", "event_id", "error")
    return (
        job_events.withColumn("error", tx.clean_error(F.coalesce(told, F.lit(NO_ERROR))))
        .groupBy("job_id")
        .agg(F.max_by(fields, newest).alias("_now"))
        .select("job_id", "_now.*")
        .filter(F.col("status") == FAILED)
    )


def job_stats(job_events: DataFrame) -> DataFrame:
    jobs = latest_jobs(job_events)
    names = {"active": RUNNING, "queued": QUEUED, "completed": COMPLETE, "failed": FAILED}
    return jobs.agg(
        *[F.count_if(F.col("status") == state).alias(name) for name, state in names.items()]
    )


def live_jobs(job_events: DataFrame, now: datetime, idle: str = JOB_IDLE) -> DataFrame:
    """Jobs without the finished ones that have been idle for longer than ``idle``."""
    cutoff = F.lit(now) - F.expr(f"INTERVAL {idle}")
    expired = F.col("status").isin(*FINAL_STATES) & (F.col("updated_at") < cutoff)
    return latest_jobs(job_events).filter(~expired)


def job_stream(
    job_events: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict = ONCE,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Writes the newest event per job of every batch.

    The newest of the newest is the newest, so readers merge the batches with
    the same functions and no streaming state can grow with the jobs. Every
    ``fold_every`` batches they are folded into one generation.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def folded(held: DataFrame) -> DataFrame:
            return latest_jobs(held).withColumn("batch_id", F.lit(batch_id))

        write_batch(latest_jobs(batch), out, batch_id)
        fold_batches(batch.sparkSession, out, batch_id, folded, fold_every)

    return (
        job_events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def streamed_jobs(spark: SparkSession, out: str) -> DataFrame:
    """Job events to give to ``latest_jobs``, ``job_stats`` and ``live_jobs``."""
    return read_since(spark, out, newest_generation(spark, out)).drop("batch_id")
