"""First rows per group without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import durable

SALTS = 256
HOT_ROWS = 200_000  # rows of a group that one task may sort


def first_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: Sequence[str],
    salts: int = SALTS,
    rank_col: str = "position",
) -> DataFrame:
    """The ``k`` first rows of each group in ``order``, numbered from 1.

    Each group is first cut to ``k`` rows in every one of ``salts`` slices, so a
    hot group is sorted by many tasks and the final window sees at most
    ``k * salts`` of its rows. ``salt_on`` must spread the rows of a group.
    """
    slice_no = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
    sliced = Window.partitionBy(*group, "_slice").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slice", slice_no)
        .withColumn(rank_col, F.row_number().over(sliced))
        .filter(F.col(rank_col) <= k)
        .drop("_slice")
        .withColumn(rank_col, F.row_number().over(whole))
        .filter(F.col(rank_col) <= k)
    )


def ranked_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank_col: str = "position",
    hot_rows: int = HOT_ROWS,
    distinct: bool = False,
) -> DataFrame:
    """All rows, numbered from 1 in every group by the columns ``order``, which must not tie.

    Rows travel once, to the task that sorts their group. Groups of more than ``hot_rows`` rows, of
    which there are at most as many as rows by ``hot_rows``, are numbered by ranges instead. ``df``
    is read to count, so give it durable or cheap. With ``distinct``, equal rows count once; they
    are found where their group is.
    """
    numbered = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    hot = durable(
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*group))
    is_hot = not hot.isEmpty()
    usual = df.join(F.broadcast(hot), list(group), "left_anti") if is_hot else df
    if distinct:
        usual = usual.repartition(*group).distinct()
    usual = usual.withColumn(rank_col, numbered)
    if not is_hot:
        return usual
    large = df.join(F.broadcast(hot), list(group), "left_semi")
    large = large.distinct() if distinct else large
    return usual.unionByName(_ranked_by_ranges(large, group, order, rank_col))


def _ranked_by_ranges(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rank_col: str
) -> DataFrame:
    """The same for groups that no task should hold.

    Groups and order together are cut in ranges by sampled splitters, so a hot
    group lies in many ranges. Rows are numbered within their range and group;
    the counts of the ranges before are added.
    """
    keys = [*group, *order]
    ranged = durable(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_range").orderBy(*order)
    return (
        ranged.withColumn("_in", F.row_number().over(within))
        .join(offsets, [*group, "_range"])
        .withColumn(rank_col, (F.col("_before") + F.col("_in")).cast("int"))
        .drop("_range", "_before", "_in")
    )


def running_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    total_col: str,
) -> DataFrame:
    """All rows with the running total of ``value`` in their group, by the columns ``order``, which
    must not tie.

    Cut in ranges as in ``ranked_per_group``: totals run within a range, those of the ranges before
    are added, so no task holds a hot group. ``df`` travels whole; give it narrow.
    """
    ranged = durable(
        df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(offsets, [*group, "_range"])
        .withColumn(total_col, F.col("_before") + F.col("_in"))
        .drop("_range", "_before", "_in")
    )
