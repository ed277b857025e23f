"""Branch and path names of remediation proposals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRANCH_ID_CHARS = 48


def branch_name(prefix: str, finding_id: Column, ts: Column) -> Column:
    safe_prefix = F.regexp_replace(F.lit(prefix), "[^A-Za-z0-9/_-]", "-")
    slug = F.substring(
        F.regexp_replace(F.lower(finding_id), "[^a-z0-9-]", "-"), 1, BRANCH_ID_CHARS
    )
    stamp = F.lower(F.conv(F.unix_millis(ts).cast("string"), 10, 36))
    return F.concat_ws("-", safe_prefix, slug, stamp)


def plan_path(folder: str, finding_id: Column) -> Column:
    name = F.regexp_replace(finding_id, "[^A-Za-z0-9_.-]", "-")
    return F.concat(F.lit(f"{folder}/remediation-"), name, F.lit(".md"))
