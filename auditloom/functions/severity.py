"""Severity maps, weights, ranks and report levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score weight and sort rank per severity.
WEIGHTS = {"critical": 25, "high": 14, "medium": 7, "low": 2}
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3}
UNKNOWN_RANK = 4


def _pick(col: Column, table: dict[str, int], default: int | None) -> Column:
    expr = None
    for name, value in table.items():
        hit = col == name
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr if default is None else expr.otherwise(default)


def severity_weight(col: Column) -> Column:
    return _pick(col, WEIGHTS, None)


def severity_rank(col: Column) -> Column:
    return _pick(col, RANKS, UNKNOWN_RANK)


def severity_level(col: Column) -> Column:
    """Level names of the SARIF format."""
    return (
        F.when(col.isin("critical", "high"), "error")
        .when(col == "medium", "warning")
        .otherwise("note")
    )


def norm_severity(col: Column) -> Column:
    """Severity of an external tool report; unknown words count as low."""
    word = F.lower(F.coalesce(F.nullif(col, F.lit("")), F.lit("medium")))
    return (
        F.when(word.isin(*RANKS), word)
        .when(word == "error", "high")
        .when(word == "warning", "medium")
        .otherwise("low")
    )


def norm_advisory_severity(col: Column) -> Column:
    """Severity of an advisory record; anything unknown, low included, is high."""
    word = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(word == "critical", "critical")
        .when(word.isin("moderate", "medium"), "medium")
        .otherwise("high")
    )
