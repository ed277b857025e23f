"""Small tables for the tests."""

from __future__ import annotations

from auditloom import schemas
from auditloom.operators.dependencies import default_baselines
from auditloom.plans.scan import Limits, scan_snapshots


def files_table(spark, rows):
    """Rows (scan_id, path, content) or (scan_id, path, content, entry_type)."""
    full = [
        (r[0], r[1], r[3] if len(r) > 3 else "file", len(r[2].encode("utf-8")), r[2])
        for r in rows
    ]
    return spark.createDataFrame(full, schemas.FILES)


def scan(spark, rows, log=(), reports=(), advisories=(), online=False, history=True,
         limits=Limits()):
    """Whole scan of the given files; every scan_id seen is listed."""
    ids = sorted({r[0] for r in rows} | {r[0] for r in log} | {r[0] for r in reports})
    listed = spark.createDataFrame(
        [(i, history, online) for i in ids],
        "scan_id string, history_available boolean, advisories_available boolean",
    )
    return scan_snapshots(
        listed,
        files_table(spark, rows),
        spark.createDataFrame(list(log), schemas.GIT_LOG),
        spark.createDataFrame(list(reports), schemas.EXTERNAL_REPORTS),
        spark.createDataFrame(list(advisories), schemas.ADVISORIES),
        default_baselines(spark),
        limits,
    )


def log_lines(scan_id, *lines):
    return [(scan_id, i, line) for i, line in enumerate(lines)]
