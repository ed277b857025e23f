"""Rule matching on lines and windows of snapshot files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators.files import walk_key, window_texts
from auditloom.operators.manifests import ITEM_TYPE
from auditloom.rules import (
    LINE_RULES,
    RULES,
    SECRET_TOOL,
    WINDOW_RULES,
    Rule,
    rule_texts,
)

DEPENDENCY_PHASE, LINE_PHASE, WINDOW_PHASE = 0, 1, 2
UNIT_TYPE = "struct<phase:int,line_no:int,text:string,name:string,version:string>"


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    A filter on a plain projected column moves below the projection and takes
    a copy of its expression along, so that every regular expression would run
    twice; it does not move below a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in cols.items()])
    return df.select("*", F.inline(F.array(row)))


def rule_mask(text: Column, folded: Column, rules: Sequence[Rule]) -> Column:
    """Bit set of the rules that match somewhere in the text.

    No rule is anchored and every gap is limited in characters, not lines, so a
    hit in a line or window is also a hit in the text that contains it.
    """
    mask = F.lit(0)
    for rule in rules:
        mask = mask + F.when(rule.matches(text, folded), 1 << rule.ord).otherwise(0)
    return mask


def rule_hit_array(
    text: Column, folded: Column, mask: Column, rules: Sequence[Rule]
) -> Column:
    """Positions of the rules in the mask that match the text."""
    if not rules:
        return F.array().cast("array<int>")
    tests = [
        F.when((mask.bitwiseAND(1 << r.ord) != 0) & r.matches(text, folded), F.lit(r.ord))
        for r in rules
    ]
    return F.array_compact(F.array(*tests))


def candidate_units(
    files: DataFrame, rules: Sequence[Rule] = RULES, dependencies: Column | None = None
) -> DataFrame:
    """Lines and windows of the files in which some rule matches at all.

    Whole contents are tested once; only files with a hit are split. With
    ``dependencies``, an array of (name, version) over path and _text, its
    items come out of the same pass as units of the dependency phase.
    """
    line_rules = [r for r in rules if r in LINE_RULES]
    window_rules = [r for r in rules if r in WINDOW_RULES]
    deps = F.array().cast(ITEM_TYPE) if dependencies is None else dependencies
    # A window joins its lines by a bare newline, so test the same form.
    plain = files.select(
        "scan_id",
        "path",
        F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n")).alias("content"),
    )
    folded = computed_once(plain, _text=F.col("content"), _folded=F.lower("content")).drop("content")
    tested = (F.col("_text"), F.col("_folded"))
    masked = computed_once(
        folded,
        _line_mask=rule_mask(*tested, line_rules),
        _window_mask=rule_mask(*tested, window_rules),
        _deps=deps,
    ).filter((F.col("_line_mask") + F.col("_window_mask") > 0) | (F.size("_deps") > 0))
    split = masked.withColumn("_lines", F.split("_text", "\n", -1))
    none = F.array().cast(f"array<{UNIT_TYPE}>")
    line_units = F.transform(
        F.col("_lines"), lambda x, i: _unit(F.lit(LINE_PHASE), i + 1, text=x)
    )
    window_units = F.transform(
        window_texts(F.col("_lines")),
        lambda w: _unit(F.lit(WINDOW_PHASE), w["line_no"], text=w["text"]),
    )
    dependency_units = F.transform(
        F.col("_deps"),
        lambda d, i: _unit(F.lit(DEPENDENCY_PHASE), i, name=d["name"], version=d["version"]),
    )
    units = F.concat(
        F.when(F.col("_line_mask") > 0, line_units).otherwise(none),
        F.when(F.col("_window_mask") > 0, window_units).otherwise(none),
        dependency_units,
    )
    return split.select(
        "scan_id",
        "path",
        (F.col("_line_mask") + F.col("_window_mask")).alias("_mask"),
        F.inline(units),
    )


def _unit(phase: Column, n: Column, **fields: Column) -> Column:
    absent = F.lit(None).cast("string")
    texts = [fields.get(f, absent).alias(f) for f in ("text", "name", "version")]
    return F.struct(phase.alias("phase"), n.alias("line_no"), *texts)


def extract(
    files: DataFrame, rules: Sequence[Rule] = RULES, dependencies: Column | None = None
) -> DataFrame:
    """Rule hits, and dependencies if asked for, in one pass over the contents.

    Columns scan_id, path, phase, line_no, text, name, version, rule_ord. A
    dependency has rule_ord NULL and its position in line_no.
    """
    units = candidate_units(files, rules, dependencies).withColumn("_folded", F.lower("text"))
    args = (F.col("text"), F.col("_folded"), F.col("_mask"))
    found = {
        LINE_PHASE: rule_hit_array(*args, [r for r in rules if r in LINE_RULES]),
        WINDOW_PHASE: rule_hit_array(*args, [r for r in rules if r in WINDOW_RULES]),
    }
    hits = (
        F.when(F.col("phase") == LINE_PHASE, found[LINE_PHASE])
        .when(F.col("phase") == WINDOW_PHASE, found[WINDOW_PHASE])
        .otherwise(F.array(F.lit(None).cast("int")))
    )
    return units.select(
        "scan_id", "path", "phase", "line_no", "text", "name", "version",
        F.explode(hits).alias("rule_ord"),
    )


def rule_hits(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule and line or window it matches: the raw matched text."""
    return extract(files, rules).drop("name", "version")


def hits_to_findings(hits: DataFrame) -> DataFrame:
    """Finding columns of raw rule hits."""
    looked_up = hits.withColumn("_rule", rule_texts(F.col("rule_ord")))
    rule, file, line = F.col("_rule.rule"), F.col("path"), F.col("line_no")
    return looked_up.select(
        "scan_id",
        ordinal(0, walk_key(file), F.col("phase"), line, F.col("rule_ord"), rule),
        tx.finding_id(rule, file, line).alias("id"),
        "_rule.severity",
        "_rule.title",
        "_rule.tool",
        "_rule.rule",
        tx.norm_path(file).alias("file"),
        line.alias("line"),
        "_rule.explanation",
        tx.evidence(F.col("_rule.tool") == SECRET_TOOL, F.col("text")).alias("evidence"),
        "_rule.patch",
        F.lit(None).cast("string").alias("commit"),
        tx.fingerprint(rule, file, F.col("text")).alias("fingerprint"),
    )


def ordinal(
    stage: int, walk: Column, phase: Column, n: Column, rule_ord: Column, rule: Column
) -> Column:
    """Position of a finding in the order in which a sequential scan meets it."""
    return F.struct(
        F.lit(stage).alias("stage"),
        walk.alias("walk"),
        phase.cast("int").alias("phase"),
        n.cast("long").alias("n"),
        rule_ord.cast("int").alias("rule_ord"),
        rule.alias("rule"),
    ).alias("ord")


def line_findings(files: DataFrame, rules: Sequence[Rule] = LINE_RULES) -> DataFrame:
    return hits_to_findings(rule_hits(files, rules))


def window_findings(files: DataFrame, rules: Sequence[Rule] = WINDOW_RULES) -> DataFrame:
    return hits_to_findings(rule_hits(files, rules))


def source_findings(files: DataFrame) -> DataFrame:
    """Line and window findings in one pass over the contents."""
    return hits_to_findings(rule_hits(files, RULES))

