"""Shards by a hierarchical weighted hash tree, as column expressions only.

A layout names regions, their racks and their shards with weights. A row descends: at each level
every child draws ``-ln(u) / weight`` with a hash ``u`` of the key and the child's name, and the
smallest draw wins. Raising or lowering a weight therefore moves rows only into or out of the
subtree it belongs to. A shard that is added to a running layout becomes a region of its own
(one rack, one shard): rows can then only move into it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Layout = Mapping[str, Mapping[str, Mapping[int, float]]]

SLOT_BUCKETS = 256  # parts of a shard that are numbered on their own


def layout(n_shards: int, planned: int = 40, racks: int = 2, per_rack: int = 5) -> Layout:
    """Regions of ``racks`` racks with ``per_rack`` shards each for the planned shards, then one
    region for every shard added later. Weights are 1."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(n_shards):
        if shard < planned:
            rack = shard // per_rack
            tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
        else:
            tree[f"added{shard}"] = {f"added{shard}": {shard: 1.0}}
    return tree


def _winner(key: Column, children: Column) -> Column:
    """The child with the smallest draw; the one that sorts first by name in a tie."""

    def drawn(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["path"]), 11)
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"], child["below"])

    return F.array_min(F.transform(children, drawn))["below"]


def _node(path: str, weight: float, below: Column) -> Column:
    return F.struct(
        F.lit(path).alias("path"), F.lit(float(weight)).alias("weight"), below.alias("below")
    )


def shard_of(key: Column, tree: Layout) -> Column:
    """Shard number of a key (long; null is a key too). Weights must be positive."""
    key = F.coalesce(key, F.lit(-(1 << 63)))
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [_node(f"shard/{region}/{rack}/{s}", w, F.lit(int(s))) for s, w in shards.items()]
            inner.append(_node(f"rack/{region}/{rack}", sum(shards.values()), F.array(*leaves)))
        weight = sum(w for shards in racks.values() for w in shards.values())
        regions.append(_node(f"region/{region}", weight, F.array(*inner)))
    return _winner(key, _winner(key, _winner(key, F.array(*regions)))).cast("int")


def numbered(df: DataFrame, shard: str, key: str, tie: str) -> DataFrame:
    """Adds ``slot``: rows of a shard numbered from 0 without gaps.

    A shard is cut in buckets by hash of ``key`` and ``tie``, buckets are counted first (a table
    of at most shards x SLOT_BUCKETS rows) and each is numbered from its own offset, so no task
    sorts a shard.
    """
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(key, tie), F.lit(SLOT_BUCKETS)).cast("int"))
    sizes = cut.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, tie)
    return (
        cut.withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(offsets), [shard, "_bucket"])
        .withColumn("slot", (F.col("_from") + F.col("_at") - 1).cast("long"))
        .drop("_bucket", "_from", "_at")
    )


def place(df: DataFrame, n_shards: int, key: str = "doc_id", planned: int = 40) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (with one shard more). Columns of the input that have
    these names are replaced; null keys share one shard; an empty table stays empty."""
    return df.withColumns({
        "shard": shard_of(F.col(key), layout(n_shards, planned)),
        "grown_shard": shard_of(F.col(key), layout(n_shards + 1, planned)),
    })
