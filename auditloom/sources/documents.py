"""Report documents of any length, as rows of text that are written in order.

A document is cut into parts (scan_id, section, position, text): what opens it, one row per finding
or event, what closes it. Joined by line ends in the order of (section, position) the parts are the
document, so no row and no task holds a whole one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.severity import severity_level
from auditloom.operators.findings import report_rules
from auditloom.operators.topk import ranked_per_group
from auditloom.sources.exports import DRIVER_VERSION, SARIF_SCHEMA, SARIF_VERSION

PART_ORDER = ("scan_id", "section", "position")

# Fields of the scan document, by column.
OPENING = {
    "scan_id": "id", "created_at": "createdAt", "completed_at": "completedAt", "status": "status",
    "previous_scan_id": "previousScanId", "repository": "repository",
}
CLOSING = {"summary": "summary", "external_scanners": "externalScanners", "comparison": "comparison"}
FINDING = {
    "id": "id", "severity": "severity", "title": "title", "tool": "tool", "rule": "rule",
    "file": "file", "line": "line", "explanation": "explanation", "evidence": "evidence",
    "patch": "patch", "status": "status", "decision": "decision", "commit": "commit",
    "fingerprint": "fingerprint", "decided_at": "decidedAt", "ai_explanation": "aiExplanation",
    "remediation_pull_request": "remediationPullRequest",
}
EVENT = {
    "type": "type", "finding_id": "findingId", "action": "action", "pull_request": "pullRequest",
    "created_at": "createdAt",
}
JSON_OPTIONS = {
    "ignoreNullFields": "false", "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
}


def _object(value: Column) -> Column:
    return F.to_json(value, JSON_OPTIONS)


def _record(df: DataFrame, fields: dict[str, str]) -> Column:
    """JSON object of the columns that are there, null where a value is not set."""
    return _object(F.struct(*[F.col(c).alias(n) for c, n in fields.items() if c in df.columns]))


def _fixed(scans: DataFrame, section: int, text: Column) -> DataFrame:
    return scans.select(
        "scan_id", F.lit(section).alias("section"), F.lit(0).alias("position"), text.alias("text"))


def _listed(rows: DataFrame, section: int, place: str, text: Column) -> DataFrame:
    """Rows of a list; all but the one in place 1 begin with a comma."""
    comma = F.when(F.col(place) > 1, ",").otherwise("")
    return rows.select(
        "scan_id", F.lit(section).alias("section"), F.col(place).alias("position"),
        F.concat(comma, text).alias("text"))


def json_parts(
    scans: DataFrame, findings: DataFrame, events: DataFrame | None = None, known: bool = False
) -> DataFrame:
    """The whole scan document: scan, repository, findings, events, summary, comparison.

    ``scans`` has one row per scan_id and any columns of OPENING and CLOSING (structs and arrays become
    objects and lists). ``findings`` bear a gapless ``position``; all of them are listed, and a scan
    without any has an empty list. Findings and events whose scan is not in ``scans`` belong to no
    document and are left out; ``known`` says that there are no such findings, which spares their
    shuffle. ``events``, if given, are listed by time and event id.
    """
    held = scans.select("scan_id")
    found = findings if known else findings.join(held, "scan_id", "left_semi")
    opening = _record(scans, OPENING)
    end = F.regexp_replace(_record(scans, CLOSING), r"^\{(?!\})", ",")
    end = F.concat(F.lit("]"), F.regexp_replace(end, r"^\{\}$", "}"))
    sections = [
        _fixed(scans, 0, F.concat(opening.substr(F.lit(1), F.length(opening) - 1), F.lit(',"findings":['))),
        _listed(found, 1, "position", _record(found, FINDING)),
    ]
    if events is None:
        sections.append(_fixed(scans, 4, end))
    else:
        own = events.join(held, "scan_id", "left_semi").drop("position")
        ranked = ranked_per_group(own, ["scan_id"], ["created_at", "event_id", "type", "finding_id"])
        sections += [
            _fixed(scans, 2, F.lit('],"events":[')),
            _listed(ranked, 3, "position", _record(ranked, EVENT)),
            _fixed(scans, 4, end),
        ]
    return reduce(DataFrame.unionByName, sections)


def sarif_parts(scans: DataFrame, findings: DataFrame, tool_name: str) -> DataFrame:
    """The SARIF document of every scan in ``scans``; ``findings`` bear a gapless ``position``.

    Rules stand in the order of their first finding, with the texts of their last one.
    """
    found = findings.join(scans.select("scan_id"), "scan_id", "left_semi")
    text = lambda c: F.struct(F.col(c).alias("text"))
    rules = report_rules(found)
    rule = F.struct(
        F.col("rule").alias("id"),
        F.col("title").alias("name"),
        text("title").alias("shortDescription"),
        text("explanation").alias("fullDescription"),
        F.struct(F.col("level")).alias("defaultConfiguration"),
    )
    place = F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine")).alias("region"),
    )
    result = F.struct(
        F.col("rule").alias("ruleId"),
        severity_level(F.col("severity")).alias("level"),
        text("title").alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    head = _object(F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema")))
    driver = _object(F.struct(F.lit(tool_name).alias("name"), F.lit(DRIVER_VERSION).alias("version")))
    unclosed = lambda c: c.substr(F.lit(1), F.length(c) - 1)
    opening = F.concat(
        unclosed(head), F.lit(',"runs":[{"tool":{"driver":'), unclosed(driver), F.lit(',"rules":['))
    return reduce(DataFrame.unionByName, [
        _fixed(scans, 0, opening),
        _listed(rules, 1, "first_position", _object(rule)),
        _fixed(scans, 2, F.lit(']}},"results":[')),
        _listed(found, 3, "position", _object(result)),
        _fixed(scans, 4, F.lit("]}]}")),
    ])


def write_documents(parts: DataFrame, path: str, ranges: int | None = None) -> None:
    """A folder ``scan_id=…`` per document; its files, read in the order of their names, are the document.

    Parts are dealt over ranges of (scan, section, position) by sampled splitters, so the parts of a hot
    scan are written by many tasks. Files are numbered by range.
    """
    # never null, so that the writer takes the order as it is and adds no sort of its own
    keyed = parts.withColumn("scan_id", F.coalesce("scan_id", F.lit("")))
    keys = [F.col(c) for c in PART_ORDER]
    dealt = keyed.repartitionByRange(*keys) if ranges is None else keyed.repartitionByRange(ranges, *keys)
    ordered = dealt.sortWithinPartitions(*keys).select("scan_id", "text")
    ordered.write.mode("overwrite").partitionBy("scan_id").text(path)
