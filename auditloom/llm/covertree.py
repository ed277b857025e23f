"""Embedding near-duplicates by cover trees, traversed two at a time.

Vectors are compared on the unit sphere, where a cosine is a distance. The upper levels come
from a bounded sample per label: farthest-first centres are nested nets of shrinking radius. They cut
a label into cells with an exact covering radius; cells that their radii keep apart never meet.
Each block of a cell gets a cover tree with halving radii, and two trees are traversed together:
node pairs beyond their covering radii plus the threshold are dropped, pairs wholly within it are
counted without looking inside, the rest is opened down to single vectors, compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import components, staged
from auditloom.llm.vectors import dimension, matrix, stack, usable

SAMPLE_ROWS = 20_000  # expected vectors the upper levels are made of
CELLS = 1_024  # cells of all labels together
BLOCK_ROWS = 2_048
SLACK = 1e-6  # of bounds only; single vectors are compared exactly


# --- trees ----------------------------------------------------------------------------------------


class Tree:
    """Nodes: centre, covering radius, members (a range of ``order``), children (node numbers)."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        n = len(unit)
        self.centre, self.radius, self.span, self.children = [], [], [], []
        self.order = np.zeros(n, np.int64)
        near = np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit.T)))
        self._split(near, np.arange(n), 0, 0)

    def _node(self, near, members, centre, at) -> int:
        self.centre.append(centre)
        self.radius.append(float(near[centre, members].max()))
        self.span.append((at, at + len(members)))
        self.children.append([])
        return len(self.centre) - 1

    def _split(self, near, members, centre, at) -> int:
        top = self._node(near, members, centre, at)
        todo = [(top, members, at)]
        while todo:
            node, members, at = todo.pop()
            if len(members) == 1 or self.radius[node] <= SLACK:
                self.order[at : at + len(members)] = members
                continue
            half, left, first = self.radius[node] / 2, members, self.centre[node]
            while len(left):
                c = first if first is not None else left[0]
                first = None
                inside = near[c, left] <= half
                child = self._node(near, left[inside], c, at)
                self.children[node].append(child)
                todo.append((child, left[inside], at))
                at += int(inside.sum())
                left = left[~inside]
        return top


def _exact(raw_a, norm_a, raw_b, norm_b, i, j, least):
    return np.einsum("ij,ij->i", raw_a[i], raw_b[j]) / (norm_a[i] * norm_b[j]) >= least


def linked_pairs(a: Tree, b: Tree, least: float, exact) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("pairs", i, j) of single vectors whose cosine is enough, and ("all", members, members)
    of node pairs that are wholly near. With one tree twice, each pair comes once, i != j."""
    same, reach = a is b, float(np.sqrt(2 - 2 * least))
    ca, cb, ra, rb = (np.array(x) for x in (a.centre, b.centre, a.radius, b.radius))
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        kids = [np.array(t.children[n] or [n]) for t, n in ((a, x), (b, y))]
        far = np.sqrt(np.maximum(0, 2 - 2 * (a.unit[ca[kids[0]]] @ b.unit[cb[kids[1]]].T)))
        spread = ra[kids[0]][:, None] + rb[kids[1]][None, :]
        p, q = np.nonzero(far <= spread + reach + SLACK)
        whole = far[p, q] + spread[p, q] < reach - SLACK
        p, q, whole = kids[0][p], kids[1][q], whole
        if same and x == y:  # the two halves of a node with itself are one
            p, q, whole = p[p <= q], q[p <= q], whole[p <= q]
        single = np.array([not a.children[n] and a.span[n][1] - a.span[n][0] == 1 for n in p.tolist()], bool) & \
            np.array([not b.children[n] and b.span[n][1] - b.span[n][0] == 1 for n in q.tolist()], bool)
        i, j = ca[p[single]], cb[q[single]]
        if same:
            i, j = i[i != j], j[i != j]
        if len(i):
            ok = exact(i, j)
            yield "pairs", i[ok], j[ok]
        for m, n, all_ in zip(p[~single].tolist(), q[~single].tolist(), whole[~single].tolist()):
            mine, other = a.order[slice(*a.span[m])], b.order[slice(*b.span[n])]
            if all_:
                yield "all", mine, other
            elif not a.children[m] and not b.children[n]:  # several vectors at one point
                i, j = (v.ravel() for v in np.meshgrid(mine, other, indexing="ij"))
                if same:
                    i, j = i[i < j] if m == n else i, j[i < j] if m == n else j
                ok = exact(i, j)
                yield "pairs", i[ok], j[ok]
            elif (m, n) != (x, y):
                todo.append((m, n))
            else:
                raise AssertionError("a pair of nodes must open")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the links i-j."""
    top = np.arange(n)
    while len(i):
        low = np.minimum(top[i], top[j])
        before = top.copy()
        np.minimum.at(top, i, low)
        np.minimum.at(top, j, low)
        top = top[top]
        if (top == before).all():
            break
    return top


def _join(dim: int, least: float):
    """Links between the blocks of a task: weights per vector, and one root per vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        raw = stack(pdf["vec"].to_numpy(), dim)
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        unit, m = raw / norm[:, None], pdf["m"].to_numpy(np.int64)
        cut = int((pdf["side"] == 0).sum())
        links, i_all, j_all = np.zeros(len(pdf), np.int64), [], []
        if not cut:
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        one = Tree(unit[:cut])
        two = one if cut == len(pdf) else Tree(unit[cut:])
        shift = 0 if two is one else cut
        exact = lambda i, j: _exact(raw, norm, raw, norm, i, j + shift, least)
        for kind, i, j in linked_pairs(one, two, least, exact):
            j = j + shift
            if kind == "pairs":
                np.add.at(links, i, m[j])
                np.add.at(links, j, m[i])
                i_all.append(i), j_all.append(j)
            elif shift == 0 and i[0] == j[0] and len(i) == len(j) and (i == j).all():
                links[i] += m[i].sum() - m[i]
                i_all.append(np.full(len(i), i[0])), j_all.append(i)
            else:
                links[i] += m[j].sum()
                links[j] += m[i].sum()
                i_all += [np.full(len(j), i[0]), np.full(len(i), j[0])]
                j_all += [j, i]
        top = _roots(len(pdf), np.concatenate(i_all or [np.zeros(0, np.int64)]),
                     np.concatenate(j_all or [np.zeros(0, np.int64)]))
        rep, hit = pdf["rep"].to_numpy(np.int64), links > 0
        return pd.DataFrame({"id": rep[hit], "links": links[hit], "root": rep[top[hit]]})

    return run


# --- upper levels ---------------------------------------------------------------------------------


def _farthest_first(unit: np.ndarray, count: int) -> np.ndarray:
    chosen, near = [0], 2 - 2 * (unit @ unit[0])
    while len(chosen) < min(count, len(unit)):
        k = int(near.argmax())
        if near[k] <= SLACK:
            break
        chosen.append(k)
        near = np.minimum(near, 2 - 2 * (unit @ unit[k]))
    return unit[chosen]


def _cells(dim: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = matrix(batch.column(2), dim)
            unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
            labels = batch.column(1).to_pylist()
            cell, far = np.zeros(len(labels), np.int32), np.zeros(len(labels))
            at: dict = {}
            for i, label in enumerate(labels):
                if label in held.value:
                    at.setdefault(label, []).append(i)
            for label, rows in at.items():
                d = 2 - 2 * (unit[rows] @ held.value[label].T)
                cell[rows] = d.argmin(axis=1)
                far[rows] = np.sqrt(np.maximum(0, d.min(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def near_duplicates(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``df``.

    Vectors link when their labels are equal and their cosine, in doubles, is at least ``least``.
    Rows without label or key, and vectors that are null, zero, of another length than most or
    hold null or non-finite components, link with nothing. Equal vectors of a label are
    compared once, as a class with a count; equal rows link with each other. ``key`` is a long.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                     F.col(vector).alias("vec"))
    dim = dimension(rows, "vec")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                        F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dim:
        return alone
    good = usable(rows.where("vec_id is not null and label is not null"), "vec", dim)
    reps = staged(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")),
                  "classes").select("rep", "label", "vec", "m")
    total = reps.count()

    # labels that fit one block stay whole; at most CELLS cells divide the others
    big = {r.label: r.n for r in reps.groupBy("label").agg(F.count("*").alias("n"))
           .where(F.col("n") > max(BLOCK_ROWS, 2 * total // CELLS)).collect()}  # at most CELLS / 2 labels
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    centres = {}
    if big:
        draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) / float(1 << 20)
        picked = reps.where(F.col("label").isin(list(big)) & (draw < share)).select("label", "vec").toPandas()
        for name, part in picked.groupby("label"):
            raw = stack(part["vec"].to_numpy(), dim)
            count = min(-(-big[name] // BLOCK_ROWS), max(1, CELLS * big[name] // (2 * total)))
            centres[name] = _farthest_first(raw / np.linalg.norm(raw, axis=1)[:, None], count)
    celled = staged(
        reps.mapInArrow(_cells(dim, spark.sparkContext.broadcast(centres)),
                        "rep long, label string, vec array<double>, m long, cell int, far double"),
        "cells",
    )
    held = staged(
        celled.groupBy("label", "cell").agg(
            F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")),
        "cell-sizes",
    )
    radius = {(r.label, r.cell): r.radius for r in held.where(F.col("label").isin(list(centres))).collect()} \
        if centres else {}
    reach, meets = float(np.sqrt(2 - 2 * least)), []
    for name, unit in centres.items():
        r = np.array([radius.get((name, c), -np.inf) for c in range(len(unit))])
        far = np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit.T)))
        x, y = np.nonzero(np.triu(far <= r[:, None] + r[None, :] + reach + SLACK))
        meets += [(name, int(i), int(j)) for i, j in zip(x, y)]
    whole = held.where(~F.col("label").isin(list(centres))) if centres else held
    pairs = whole.select("label", F.col("cell").alias("c1"), F.col("cell").alias("c2"))
    if meets:
        pairs = pairs.union(spark.createDataFrame(meets, "label string, c1 int, c2 int"))
    size = held.select("label", "cell", "parts")
    pairs = staged(
        pairs.join(size.toDF("label", "c1", "n1"), ["label", "c1"])
        .join(size.toDF("label", "c2", "n2"), ["label", "c2"]),
        "cell-pairs",
    )
    blocks = celled.join(size, ["label", "cell"]).withColumn(
        "p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def side(this: int) -> DataFrame:
        other = 3 - this
        placed = blocks.withColumnRenamed("cell", f"c{this}").withColumnRenamed("p", f"p{this}")
        met = placed.join(pairs, ["label", f"c{this}"]).withColumn(
            f"p{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        met = met.where("c1 < c2 or p1 <= p2" if this == 1 else "c1 < c2 or p1 < p2")
        return met.select("label", "c1", "p1", "c2", "p2", F.lit(this - 1).alias("side"), "rep", "m", "vec")

    found = staged(
        side(1).union(side(2)).groupBy("label", "c1", "p1", "c2", "p2")
        .applyInPandas(_join(dim, least), "id long, links long, root long"),
        "links",
    )
    of_class = staged(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components")
    counted = staged(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
    told = staged(
        reps.join(counted, F.col("rep") == counted["id"], "left").drop("id")
        .join(of_class, F.col("rep") == of_class["id"], "left")
        .select(F.col("label").alias("_l"), F.col("vec").alias("_v"),
                (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")),
        "told",
    )
    usable_vec = F.when(
        F.col("vec_id").isNotNull() & (F.size("vec") == dim), F.col("vec").cast("array<double>"))
    return rows.withColumn("vec", usable_vec).join(
        told, (F.col("label") == F.col("_l")) & (F.col("vec") == F.col("_v")), "left"
    ).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
