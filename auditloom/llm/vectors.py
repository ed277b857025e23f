"""Vector tables: which vectors take part, and arrays of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vector: str) -> int:
    """The most common length of the vectors, the smaller one in a tie; 0 without vectors."""
    row = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return row.d if row else 0


def usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite components, not all zero; the vector as doubles."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return df.where((F.size(vector) == dim) & ok & F.exists(v, lambda x: x != 0)).withColumn(vector, v)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def stack(values, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, dim))
