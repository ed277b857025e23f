"""Joins of the dependency inventory with version baselines and advisories.

The inventory is always the left side. A dependency used nearly everywhere makes
a hot key there; both joins are inner equi joins, so AQE splits such a partition
on the inventory side and repeats only the few matching right rows. Advisories and
baselines grow with the packages there are, and their estimates miss rows that are
exploded or well compressed, so both are merged and never sent through the driver. So are
the snapshots that the advisory source was available for, or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions.severity import norm_advisory_severity
from auditloom.functions.versions import bound_key, version_key
from auditloom.operators.match import DEPENDENCY_PHASE, ordinal
from auditloom.rules import ADVISORY_TOOL, BASELINE_TOOL
from auditloom.session import per_scan

# Fixed values: (name, first safe version, severity, advisory).
BASELINES = (
    ("lodash", "4.17.21", "high", "CVE-2021-23337"),
    ("minimist", "1.2.6", "high", "CVE-2021-44906"),
    ("axios", "0.21.2", "high", "CVE-2021-3749"),
)
# Fixed value: patch text of advisory findings.
ADVISORY_PATCH = (
    "Upgrade to a fixed version listed by the advisory, regenerate the lock file and run "
    "the full test suite."
)


def default_baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(BASELINES), "name string, below string, severity string, advisory string"
    )


def _quoted(name, version):
    return F.concat(F.lit('"'), name, F.lit('": "'), version, F.lit('"'))


def _finding_columns(rows: DataFrame, tool: str) -> DataFrame:
    """Common finding columns over rule, file, evidence and text columns."""
    line = F.lit(1)
    return rows.select(
        "scan_id",
        ordinal(
            0, F.col("walk"), F.lit(DEPENDENCY_PHASE), F.col("pos"), F.lit(0), F.col("rule")
        ),
        tx.finding_id(F.col("rule"), F.col("file"), line).alias("id"),
        "severity",
        "title",
        F.lit(tool).alias("tool"),
        "rule",
        tx.norm_path(F.col("file")).alias("file"),
        line.alias("line"),
        "explanation",
        tx.evidence(F.lit(False), F.col("evidence")).alias("evidence"),
        "patch",
        F.lit(None).cast("string").alias("commit"),
        tx.fingerprint(F.col("rule"), F.col("file"), F.col("evidence")).alias("fingerprint"),
    )


def baseline_findings(inventory: DataFrame, baselines: DataFrame) -> DataFrame:
    """Dependencies whose version is below the first safe version of the name."""
    keyed = baselines.withColumn("below_key", bound_key(F.col("below"))).hint("merge")
    i, b = inventory.alias("i"), keyed.alias("b")
    below = version_key(F.col("i.version")) < F.col("b.below_key")
    hit = i.join(b, (F.col("i.name") == F.col("b.name")) & below)
    name, version = F.col("i.name"), F.col("i.version")
    rows = hit.select(
        "i.scan_id",
        "i.walk",
        "i.pos",
        "i.file",
        F.concat(F.lit("DEP-"), F.upper(name)).alias("rule"),
        "b.severity",
        F.concat(F.lit("Vulnerable "), name, F.lit(" dependency")).alias("title"),
        F.concat(
            name, F.lit(" "), version, F.lit(" is below the patched baseline "),
            F.col("b.below"), F.lit(" ("), F.col("b.advisory"),
            F.lit("). Upgrade it and run the project test suite."),
        ).alias("explanation"),
        _quoted(name, version).alias("evidence"),
        F.array(
            F.concat(F.lit("- "), _quoted(name, version)),
            F.concat(F.lit("+ "), _quoted(name, F.col("b.below")), F.lit(" or newer")),
        ).alias("patch"),
    )
    return _finding_columns(rows, BASELINE_TOOL)


def advisory_findings(inventory: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding per dependency and advisory of exactly that version."""
    keys = ["ecosystem", "name", "version"]
    adv = advisories.select(
        *keys, "id", "summary", F.col("severity").alias("adv_severity")
    ).hint("merge")
    name, version = F.col("name"), F.col("version")
    default = F.concat(
        name, F.lit(" "), version, F.lit(" is affected by a published OSV advisory.")
    )
    rows = inventory.join(adv, keys).select(
        "scan_id",
        "walk",
        "pos",
        "file",
        F.col("id").alias("rule"),
        norm_advisory_severity(F.col("adv_severity")).alias("severity"),
        F.concat(F.col("id"), F.lit(" affects "), name).alias("title"),
        F.coalesce(tx.blank_to_null(F.col("summary")), default).alias("explanation"),
        F.concat(F.col("ecosystem"), F.lit(":"), name, F.lit(" "), version).alias("evidence"),
        F.array(F.lit(ADVISORY_PATCH)).alias("patch"),
    )
    return _finding_columns(rows, ADVISORY_TOOL)


def dependency_findings(
    inventory: DataFrame,
    advisories: DataFrame,
    baselines: DataFrame,
    scans: DataFrame,
    npm_limit: int | None = None,
) -> DataFrame:
    """Advisory findings, or baselines where the advisory source was not available.

    ``inventory`` is the unlimited one; ``scans`` has scan_id and
    advisories_available. Only the advisory look-up is held to
    ``npm_limit`` entries of a lock file, if given; the fallback covers npm lock files only. Availability is tested on
    the hits, so that the inventory itself is not shuffled by snapshot.
    """
    is_npm = F.col("ecosystem") == "npm"
    looked_up = inventory
    if npm_limit is not None:
        looked_up = inventory.filter(~is_npm | (F.col("pos") < npm_limit))
    online = per_scan(scans.filter("advisories_available").select("scan_id"))
    offline = per_scan(scans.filter("not advisories_available").select("scan_id"))
    return (
        advisory_findings(looked_up, advisories)
        .join(online, "scan_id", "left_semi")
        .unionByName(
            baseline_findings(inventory.filter(is_npm), baselines).join(
                offline, "scan_id", "left_semi"
            )
        )
    )
