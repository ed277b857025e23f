"""Nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample at the median of random projections; only their planes are kept and
broadcast. Every vector is then filed in one leaf of each tree. A query goes down all trees with
one priority queue: the side of a plane it does not take waits with its distance to that plane,
and the nearest waiting side of any tree is opened next. Vectors of opened leaves are compared
exactly, leaf by leaf, and the nearest of all leaves remain.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import staged
from auditloom.llm.vectors import dimension, matrix, stack, usable

SAMPLE_ROWS = 20_000  # expected vectors the planes are made of
TREES, DEPTH = 4, 8
OPENED = 0.3  # part of all leaves of all trees that a query opens
BLOCK_ROWS = 4_096  # vectors of a leaf compared in one task


def fit(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """Planes of complete binary trees: normals (trees, nodes, dim) and offsets (trees, nodes)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    normals = np.zeros((trees, 2**depth - 1, dim))
    offsets = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        groups = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            rows = groups.pop(node, np.zeros(0, np.int64))
            way = rng.normal(size=dim)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                way = a - b if (a != b).any() else way
            way = way / np.linalg.norm(way)
            along = sample[rows] @ way
            normals[t, node], offsets[t, node] = way, np.median(along) if len(rows) else 0.0
            groups[2 * node + 1] = rows[along <= offsets[t, node]]
            groups[2 * node + 2] = rows[along > offsets[t, node]]
    return normals, offsets


def leaves(forest, x: np.ndarray) -> np.ndarray:
    """Leaf of every row in every tree, as (rows, trees)."""
    normals, offsets = forest
    trees, nodes = offsets.shape
    out = np.zeros((len(x), trees), np.int32)
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        while at.size and at[0] < nodes:
            along = np.einsum("ij,ij->i", x, normals[t, at]) - offsets[t, at]
            at = 2 * at + 1 + (along > 0)
        out[:, t] = at - nodes
    return out


def opened(forest, q: np.ndarray, count: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the ``count`` leaves that one queue over all trees opens first."""
    normals, offsets = forest
    trees, nodes = offsets.shape
    along = np.einsum("tnd,d->tn", normals, q) - offsets
    waiting, found = [(0.0, t, 0) for t in range(trees)], []
    while waiting and len(found) < count:
        far, t, at = heapq.heappop(waiting)
        while at < nodes:
            side = along[t, at]
            near, other = (2 * at + 2, 2 * at + 1) if side > 0 else (2 * at + 1, 2 * at + 2)
            heapq.heappush(waiting, (max(far, abs(float(side))), t, other))
            at = near
        found.append((t, at - nodes))
    return found


def _filed(forest, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value[1].shape[0]
        for batch in batches:
            leaf = leaves(forest.value, matrix(batch.column(1), dim))
            again = pa.array(np.tile(np.arange(batch.num_rows), trees))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(trees, dtype=np.int32), batch.num_rows)),
                 pa.array(leaf.T.ravel()), batch.column(0).take(again), batch.column(1).take(again)],
                ["tree", "leaf", "id", "vec"])

    return run


def _asked(forest, dim: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, leaf, i) for i, q in enumerate(matrix(batch.column(1), dim))
                    for t, leaf in opened(forest.value, q, count)]
            at = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 batch.column(0).take(at), batch.column(1).take(at)], ["tree", "leaf", "id", "vec"])

    return run


def _nearest(dim: int, k: int):
    """The k nearest vectors of a leaf's block for each query that opened it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            ids, x = left["id"].to_numpy(np.int64), stack(left["vec"].to_numpy(), dim)
            several = bool((ids[1:] == ids[:-1]).any())  # vectors of one id: the nearest counts
            for query, q in zip(right["id"].tolist(), right["vec"].tolist()):
                far = np.sqrt(((x - np.asarray(q)) ** 2).sum(axis=1))
                far[ids == query] = np.inf
                top = np.argsort(far, kind="stable")  # by distance, ties by id
                if several:
                    top = top[np.sort(np.unique(ids[top], return_index=True)[1])]
                top = top[:k]
                top = top[ids[top] != query]
                out.append(pd.DataFrame({"query_id": query, "id": ids[top], "score": far[top]}))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"),
             "score": pd.Series([], dtype="float64")})

    return run


def neighbours(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id",
               vector: str = "embedding", share: float = OPENED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found by Euclidean distance.

    ``queries`` has rows of the same columns. A query's own key is no candidate; ties go to the
    smaller key; fewer candidates give fewer rows, none gives none. Null keys and vectors that are
    null, zero, of another length than most, or hold null or non-finite components take no
    part. Repeated rows of one key count once, by the nearest if their vectors differ. ``share`` of all leaves is opened per query.
    """
    spark = df.sparkSession
    dim = dimension(df, vector)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return none

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
        return usable(rows, "vec", dim)

    rows = staged(clean(df).distinct(), "vectors")
    # the planes come from different vectors, so that copies of one neither fill the sample nor skew it
    total = rows.agg(F.approx_count_distinct(F.xxhash64("vec"))).first()[0]
    draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(draw < min(1.0, SAMPLE_ROWS / max(1, total))).select("vec").distinct().toPandas()
    # deep enough to part the sample, no deeper
    depth = max(0, min(DEPTH, int(np.log2(max(1, len(picked) / 8)))))
    forest = fit(stack(picked["vec"].to_numpy(), dim), TREES, depth)
    held = spark.sparkContext.broadcast(forest)
    filed = staged(rows.mapInArrow(_filed(held, dim), "tree int, leaf int, id long, vec array<double>"), "filed")
    parts = staged(
        filed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")), "leaves")
    small = F.broadcast(parts)  # at most TREES * 2^DEPTH rows
    asked = clean(queries).mapInArrow(
        _asked(held, dim, max(1, round(share * TREES * 2**depth))),
        "tree int, leaf int, id long, vec array<double>",
    ).join(small, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "tree", "leaf", "part", "id", "vec").toDF("tree", "leaf", "part", "id", "vec")
    blocks = filed.join(small, ["tree", "leaf"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int")).select(
        "tree", "leaf", "part", "id", "vec").toDF("tree", "leaf", "part", "id", "vec")
    met = blocks.groupBy("tree", "leaf", "part").cogroup(asked.groupBy("tree", "leaf", "part")).applyInPandas(
        _nearest(dim, k), "query_id long, id long, score double")
    best = met.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
