"""Report documents: nested JSON, SARIF and remediation plans.

The findings given here are the stored ones: numbered by ``position`` and cut
per snapshot, so that a document has a bounded number of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions.severity import severity_level
from auditloom.operators.findings import report_rules

# Fixed values of the SARIF 2.1.0 format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
DRIVER_VERSION = "1.0.0"

FINDING_FIELDS = (
    "id", "severity", "title", "tool", "rule", "file", "line", "explanation", "evidence",
    "patch", "status", "decision", "commit", "fingerprint",
)


def _ordered(position: str, value: Column) -> Column:
    """Values of a group in the order of ``position``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def json_documents(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Full scan documents with the findings nested back in order."""
    present = [c for c in FINDING_FIELDS if c in findings.columns]
    record = F.struct(*present)
    nested = findings.groupBy("scan_id").agg(_ordered("position", record).alias("findings"))
    joined = scans.join(nested, "scan_id", "left")
    empty = F.array().cast(nested.schema["findings"].dataType)
    return joined.withColumn("findings", F.coalesce("findings", empty))


def export_json(scans: DataFrame, findings: DataFrame, path: str) -> None:
    json_documents(scans, findings).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def sarif_documents(scans: DataFrame, findings: DataFrame, tool_name: str) -> DataFrame:
    """One SARIF text per scan, also for scans without findings."""
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct(
        F.col("rule").alias("id"),
        F.col("title").alias("name"),
        text("title").alias("shortDescription"),
        text("explanation").alias("fullDescription"),
        F.struct(F.col("level")).alias("defaultConfiguration"),
    )
    rules = report_rules(findings).groupBy("scan_id").agg(
        _ordered("first_position", rule).alias("rules")
    )
    location = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule").alias("ruleId"),
        severity_level(F.col("severity")).alias("level"),
        text("title").alias("message"),
        F.array(location).alias("locations"),
    )
    results = findings.groupBy("scan_id").agg(_ordered("position", result).alias("results"))
    no_rules = F.array().cast(rules.schema["rules"].dataType)
    no_results = F.array().cast(results.schema["results"].dataType)
    driver = F.struct(
        F.lit(tool_name).alias("name"),
        F.lit(DRIVER_VERSION).alias("version"),
        F.coalesce("rules", no_rules).alias("rules"),
    )
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.coalesce("results", no_results).alias("results"),
    )
    document = F.struct(
        F.lit(SARIF_VERSION).alias("version"),
        F.lit(SARIF_SCHEMA).alias("$schema"),
        F.array(run).alias("runs"),
    )
    return (
        scans.select("scan_id")
        .join(rules, "scan_id", "left")
        .join(results, "scan_id", "left")
        .select("scan_id", F.to_json(document).alias("sarif"))
    )


def export_sarif(scans: DataFrame, findings: DataFrame, tool_name: str, path: str) -> None:
    sarif_documents(scans, findings, tool_name).select("sarif").write.mode("overwrite").text(path)


def remediation_documents(scans: DataFrame, findings: DataFrame, tool_name: str) -> DataFrame:
    """Markdown plan per finding; untrusted text is escaped or indented.

    ``scans`` has scan_id and commit. Findings are on the left: AQE splits a
    snapshot that holds very many of them.
    """
    f = findings.drop("commit").join(
        scans.select("scan_id", F.col("commit").alias("scanned_commit")), "scan_id"
    )
    explanation = F.coalesce(
        tx.blank_to_null(F.col("ai_explanation")), F.col("explanation")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda label, *cols: F.concat(F.lit(f"- {label}: "), *cols)
    lines = [
        F.lit(f"# {tool_name} remediation plan"),
        F.lit(""),
        field("Scan", text("scan_id")),
        field("Repository commit", text("scanned_commit")),
        field("Finding", text("id")),
        field("Severity", text("severity")),
        field("Location", text("file"), F.lit(":"), text("line")),
        F.lit(""),
        F.lit("## Finding"),
        F.lit(""),
        tx.escape_angle(F.col("title")),
        F.lit(""),
        tx.escape_angle(explanation),
        F.lit(""),
        F.lit("## Evidence"),
        F.lit(""),
        tx.indent_block(F.col("evidence")),
        F.lit(""),
        F.lit("## Recommended change"),
        F.lit(""),
        tx.indent_block(F.array_join("patch", "\n")),
        F.lit(""),
        F.lit(
            "> Review and implement this recommendation before merging. "
            f"{tool_name} intentionally does not execute repository code."
        ),
        F.lit(""),
    ]
    return f.select("scan_id", "ord", "id", F.concat_ws("\n", *lines).alias("document"))
