"""Staged commit history logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.operators.files import base_name, text_lines
from auditloom.session import broadcast_if_small, durable

# Usual limits of one log, for callers that want them.
HISTORY_COMMITS, HISTORY_CHARS = 50, 5_000_000

MARK_BYTES = 3  # of a byte order mark in UTF-8


def split_logs(
    logs: DataFrame, commits: int | None = None, chars: int | None = None
) -> DataFrame:
    """Numbered lines of (scan_id, log) rows, whole or up to ``commits`` commits and ``chars``
    characters."""
    head = F.col("log") if chars is None else F.substring("log", 1, chars)
    if commits is not None:
        by_commit = F.split(head, r"(?m)^commit:", -1)
        head = F.array_join(F.slice(by_commit, 1, max(1, commits) + 1), "commit:")
    return logs.select("scan_id", F.posexplode(text_lines(head))).select(
        "scan_id", F.col("pos").cast("long").alias("seq"), F.col("col").alias("line")
    )


def _scan_of(file: Column) -> Column:
    """The snapshot a log file is named after.

    The path is percent-encoded, but a plus sign in it stands for itself.
    """
    name = F.url_decode(F.replace(base_name(file), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.log\z", "")


def history_lines(
    spark: SparkSession, path: str, commits: int | None = None, chars: int | None = None
) -> DataFrame:
    """Lines of the logs in a folder of ``<scan_id>.log`` files.

    Whole logs are read by byte ranges, so one long log is read by many tasks. Logs that are cut to
    ``commits`` or ``chars`` are read as one row each, before the cut.
    """
    if commits is None and chars is None:
        return _ranged_lines(spark, path)
    raw = spark.read.text(path, wholetext=True)
    logs = raw.select(_scan_of(F.col("_metadata.file_path")).alias("scan_id"), F.col("value").alias("log"))
    return split_logs(logs, commits, chars)


def _ranged_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines numbered by their place in their block and the lines of the blocks before.

    A block is read by one task in order, so its ids rise. Its offset comes from the counts of the
    blocks of that log, which are few. The reader drops the line breaks: sizes tell whether a log ends
    in one, with an empty line behind it. It drops a byte order mark as well. An empty file has no line,
    as Spark passes it by.
    """
    read = durable(
        spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("value").alias("_raw"),
        ),
        "history",
    )
    blocks = durable(read.groupBy("_file", "_block").agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.octet_length("_raw").cast("long") + 1).alias("_held"),
    ))
    none = F.lit(0).cast("long")
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), "length")
    held = blocks.groupBy("_file").agg(F.sum("_n").alias("_n"), F.sum("_held").alias("_held"))
    logs = durable(sizes.join(held, "_file", "left").select(
        "_file",
        F.coalesce("_n", none).alias("_n"),
        (F.col("length") - F.coalesce("_held", none)).isin(0, MARK_BYTES).alias("_ended"),
    ))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file", "_block", (F.coalesce(F.sum("_n").over(before), none) - F.col("_first")).alias("_shift"))
    placed = durable(starts.join(logs, "_file"))
    seq = F.col("_at") + F.col("_shift")
    unbroken = ~F.col("_ended") & (seq == F.col("_n") - 1)  # its carriage return is no part of a line break
    lines = read.join(broadcast_if_small(placed), ["_file", "_block"]).select(
        "_file",
        seq.alias("seq"),
        F.when(unbroken, F.col("_raw")).otherwise(F.regexp_replace("_raw", r"\r\z", "")).alias("line"),
    )
    ends = logs.filter("_ended").select("_file", F.col("_n").alias("seq"), F.lit("").alias("line"))
    return lines.unionByName(ends).select(_scan_of(F.col("_file")).alias("scan_id"), "seq", "line")
