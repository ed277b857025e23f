"""Reviewer decisions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from auditloom.operators.review import apply_decisions, newest_decisions, valid_decisions
from auditloom.streaming.sinks import (
    FOLD_EVERY,
    ONCE,
    fold_batches,
    newest_generation,
    read_since,
    write_batch,
)


def decision_stream(
    events: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict = ONCE,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Appends the valid decisions of each batch to the event log.

    Decisions are never applied in place: the log is reduced on reading, so
    concurrent, late and repeated ones do no harm, none is dropped and no state
    is kept. Every ``fold_every`` batches the newest decision of each finding goes
    into a generation; the batches stay as the whole log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, batch_id)
        fold_batches(batch.sparkSession, out, batch_id, newest_decisions, fold_every)

    return (
        valid_decisions(events)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def decided_findings(spark: SparkSession, findings: DataFrame, out: str) -> DataFrame:
    """The findings with all logged decisions applied."""
    return apply_decisions(findings, read_since(spark, out, newest_generation(spark, out)))
