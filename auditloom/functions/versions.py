"""Dotted version comparison by sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(col: Column) -> Column:
    """Numeric parts; a part that is not all digits counts as zero."""
    digits = lambda p: (p != "") & (F.translate(p, "0123456789", "") == "")
    return F.transform(
        F.split(col, r"\."),
        lambda p: F.when(digits(p), p.cast("double")).otherwise(F.lit(0.0)),
    )


def bound_key(col: Column) -> Column:
    """Sort key of a version bound.

    A missing part counts as zero, so zeros at the end are dropped; the arrays
    then compare part by part, and a shorter one is lower than its extensions.
    """

    def trimmed(parts: Column) -> Column:
        places = F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0))
        return F.slice(parts, 1, F.array_max(places))

    # One-element array: the parts are computed once for both uses.
    return F.get(F.transform(F.array(_parts(col)), trimmed), F.lit(0))


def version_key(col: Column) -> Column:
    """Sort key of a listed version; what precedes its first digit is ignored."""
    return bound_key(F.regexp_replace(col, r"\A[^0-9]+", ""))


def version_below(version: Column, bound: Column) -> Column:
    return version_key(version) < bound_key(bound)
