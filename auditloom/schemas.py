"""Schemas of the stored tables."""

from __future__ import annotations

ORD = (
    "struct<stage:int,walk:string,phase:int,n:bigint,rule_ord:int,rule:string>"
)

FILES = "scan_id string, path string, entry_type string, length bigint, content string"

ARCHIVE_ENTRIES = "scan_id string, seq bigint, path string, entry_type string, size bigint"

GIT_LOG = "scan_id string, seq bigint, line string"

ADVISORIES = (
    "ecosystem string, name string, version string, id string, summary string, severity string"
)

EXTERNAL_REPORTS = "scan_id string, tool string, report string"

REVIEW_EVENTS = (
    "event_id bigint, scan_id string, finding_id string, action string, created_at timestamp"
)

JOB_EVENTS = (
    "event_id bigint, job_id string, status string, progress int, phase string, "
    "updated_at timestamp"
)

REQUEST_EVENTS = "event_id bigint, client string, category string, ts timestamp"

SNAPSHOT_NOTICES = "scan_id string, url string, created_at timestamp, previous_scan_id string"
