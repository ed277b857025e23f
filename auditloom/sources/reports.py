"""Reports of external scanners, normalised to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions.severity import norm_severity
from auditloom.operators.match import ordinal
from auditloom.session import per_scan

# Tool names in order, default texts and patches.
SEMGREP, GITLEAKS, OSV_SCANNER = "Semgrep", "Gitleaks", "OSV-Scanner"
TOOLS = (SEMGREP, GITLEAKS, OSV_SCANNER)
DEFAULT_EVIDENCE = "Scanner evidence available in the exported report."
DEFAULT_PATCH = ("Review the scanner guidance and apply the smallest safe remediation.",)
DEFAULT_FILE = "unknown"
SEMGREP_EXPLANATION = "Semgrep identified a security-sensitive code pattern."
GITLEAKS_TITLE = "Secret detected in source"
GITLEAKS_EXPLANATION = (
    "Gitleaks matched a credential pattern. Rotate the credential before removing it from "
    "the repository history."
)
GITLEAKS_PATCH = ("- committed secret", "+ protected runtime environment variable")
OSV_EXPLANATION = "OSV reports a known vulnerability in a resolved dependency."
OSV_PATCH = (
    "Upgrade to a fixed version listed by the advisory, reinstall dependencies and run tests.",
)

SEMGREP_REPORT = (
    "results array<struct<check_id:string,path:string,start:struct<line:string>,"
    "extra:struct<severity:string,message:string,lines:string,fix:string,"
    "metadata:struct<shortDescription:string>>>>"
)
GITLEAKS_REPORT = (
    "array<struct<RuleID:string,Description:string,File:string,StartLine:string,Fingerprint:string>>"
)
OSV_REPORT = (
    "results array<struct<source:struct<path:string>,packages:array<struct<"
    "package:struct<name:string,version:string>,vulnerabilities:array<struct<"
    "id:string,summary:string,database_specific:struct<severity:string>>>>>>>"
)


def _or(col: Column, *fallbacks: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(tx.blank_to_null(col), *fallbacks)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _word(col: Column) -> Column:
    """A missing value as it appears inside composed ids and titles."""
    return F.coalesce(col, F.lit("undefined"))


ITEM = (
    "struct<id:string,level:string,title:string,rule:string,file:string,line:string,"
    "explanation:string,evidence:string,patch:array<string>>"
)


def _item(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _semgrep_items() -> Column:
    def item(r: Column, i: Column) -> Column:
        check, message, fix = r["check_id"], r["extra"]["message"], r["extra"]["fix"]
        return _item(
            id=F.concat(F.lit("SEMGREP-"), i.cast("string"), F.lit("-"), _word(check)),
            level=r["extra"]["severity"],
            title=_or(message, check),
            rule=check,
            file=r["path"],
            line=r["start"]["line"],
            explanation=_or(
                r["extra"]["metadata"]["shortDescription"],
                tx.blank_to_null(message),
                F.lit(SEMGREP_EXPLANATION),
            ),
            evidence=r["extra"]["lines"],
            patch=F.when(F.coalesce(fix, F.lit("")) != "", F.array(fix)).otherwise(
                _strings(DEFAULT_PATCH)
            ),
        )

    return F.transform(F.from_json(tx.whole_json(F.col("report"), "}"), SEMGREP_REPORT)["results"], item)


def _gitleaks_items() -> Column:
    def item(r: Column, i: Column) -> Column:
        rule = r["RuleID"]
        return _item(
            id=F.concat(F.lit("GITLEAKS-"), i.cast("string"), F.lit("-"), _word(rule)),
            level=F.lit("critical"),
            title=_or(r["Description"], F.lit(GITLEAKS_TITLE)),
            rule=rule,
            file=r["File"],
            line=r["StartLine"],
            explanation=F.lit(GITLEAKS_EXPLANATION),
            evidence=F.concat(
                F.lit("Fingerprint: "), _or(r["Fingerprint"], F.lit("redacted"))
            ),
            patch=_strings(GITLEAKS_PATCH),
        )

    # A report that is not an array holds no findings.
    is_array = F.col("report").rlike(rf"\A[{tx.WS}]*\[")
    return F.transform(F.when(is_array, F.from_json(tx.whole_json(F.col("report"), "]"), GITLEAKS_REPORT)), item)


def _flat(levels: Column, inner) -> Column:
    """Concatenation of one array per element; missing arrays count as empty."""
    return F.flatten(F.filter(F.transform(levels, inner), lambda a: a.isNotNull()))


def _osv_items() -> Column:
    """The nest is flattened inside the row, so the position is the running index."""
    flat = _flat(
        F.from_json(tx.whole_json(F.col("report"), "}"), OSV_REPORT)["results"],
        lambda res: _flat(
            res["packages"],
            lambda pkg: F.transform(
                pkg["vulnerabilities"],
                lambda v: _item(
                    path=res["source"]["path"],
                    name=pkg["package"]["name"],
                    version=pkg["package"]["version"],
                    id=v["id"],
                    summary=v["summary"],
                    severity=v["database_specific"]["severity"],
                ),
            ),
        ),
    )

    def item(r: Column, i: Column) -> Column:
        rule, name = r["id"], r["name"]
        return _item(
            id=F.concat(F.lit("OSV-"), _word(rule), F.lit("-"), i.cast("string")),
            level=_or(r["severity"], F.lit("high")),
            title=F.concat(_word(rule), F.lit(" affects "), _or(name, F.lit("a dependency"))),
            rule=rule,
            file=_or(r["path"], F.lit("dependency manifest")),
            line=F.lit("1"),
            explanation=_or(r["summary"], F.lit(OSV_EXPLANATION)),
            evidence=F.concat(
                _or(name, F.lit("package")),
                F.lit(" "),
                _or(r["version"], F.lit("unknown version")),
            ),
            patch=_strings(OSV_PATCH),
        )

    return F.transform(flat, item)


_ITEMS = {SEMGREP: _semgrep_items, GITLEAKS: _gitleaks_items, OSV_SCANNER: _osv_items}


def _findings(reports: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Findings of the given tools in one pass over the reports."""
    items, phase = None, None
    for t in tools:
        mine, n = F.col("tool") == t, TOOLS.index(t)
        value = _ITEMS[t]().cast(f"array<{ITEM}>")
        items = F.when(mine, value) if items is None else items.when(mine, value)
        phase = F.when(mine, n) if phase is None else phase.when(mine, n)
    rows = reports.filter(F.col("tool").isin(*tools)).select(
        "scan_id", "tool", phase.alias("_phase"), F.posexplode(items).alias("_index", "r")
    )
    # Numbers may come quoted; nothing and zero mean the first line.
    number = F.col("r.line").try_cast("double").cast("int")
    line = F.when(F.coalesce(number, F.lit(0)) == 0, 1).otherwise(number)
    return rows.select(
        "scan_id",
        ordinal(2, F.lit(""), F.col("_phase"), F.col("_index"), F.lit(0), F.col("r.rule")),
        "r.id",
        norm_severity(F.col("r.level")).alias("severity"),
        "r.title",
        "tool",
        "r.rule",
        tx.norm_path(_or(F.col("r.file"), F.lit(DEFAULT_FILE))).alias("file"),
        line.alias("line"),
        "r.explanation",
        F.substring(_or(F.col("r.evidence"), F.lit(DEFAULT_EVIDENCE)), 1, tx.EVIDENCE_CHARS)
        .alias("evidence"),
        "r.patch",
        F.lit(None).cast("string").alias("commit"),
        F.lit(None).cast("string").alias("fingerprint"),
    )


def semgrep_findings(reports: DataFrame) -> DataFrame:
    return _findings(reports, (SEMGREP,))


def gitleaks_findings(reports: DataFrame) -> DataFrame:
    return _findings(reports, (GITLEAKS,))


def osv_report_findings(reports: DataFrame) -> DataFrame:
    return _findings(reports, (OSV_SCANNER,))


def external_findings(reports: DataFrame) -> DataFrame:
    return _findings(reports, TOOLS)


def external_tool_status(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Availability and finding count of every tool for each reported snapshot.

    A report row with text, even blank or broken, means that the tool ran; a
    NULL report or no row means that it is not installed.
    """
    ran = reports.groupBy("scan_id").agg(
        *[
            F.max((F.col("tool") == t) & F.col("report").isNotNull()).alias(t)
            for t in TOOLS
        ]
    )
    tools = F.array(
        *[F.struct(F.lit(t).alias("tool"), F.col(t).alias("available")) for t in TOOLS]
    )
    status = ran.select("scan_id", F.inline(tools))
    counts = findings.filter(F.col("tool").isin(*TOOLS)).groupBy("scan_id", "tool").agg(
        F.count(F.lit(1)).alias("n")
    )
    return status.join(per_scan(counts), ["scan_id", "tool"], "left").select(
        "scan_id",
        "tool",
        F.coalesce("available", F.lit(False)).alias("available"),
        F.coalesce("n", F.lit(0)).cast("int").alias("finding_count"),
    )


def external_tool_names(status: DataFrame) -> DataFrame:
    """Names to append to the scanner list: only where some external finding exists."""
    at = F.struct(
        F.array_position(_strings(TOOLS), F.col("tool")).alias("at"), F.col("tool").alias("tool")
    )
    return (
        status.groupBy("scan_id")
        .agg(
            F.sum("finding_count").alias("_n"),
            F.array_sort(F.collect_list(F.when(F.col("available"), at))).alias("_tools"),
        )
        .filter(F.col("_n") > 0)
        .select("scan_id", F.transform("_tools", lambda t: t["tool"]).alias("external_tools"))
    )
