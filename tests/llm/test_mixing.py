"""Targets against water-filling by hand, and what documents are given."""

import random
import re

import pytest

from auditloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken double"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, weights, most):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**target, **share}, sizes
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target, sizes


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        n = rng.choice([0, 1, 3, 10, 40, 200, 3000 if rng.random() < 0.03 else 5])
        s = rng.choice(["a"] * 30 + ["b", "b", "c", "d", "é", None, "B", "tiny" if n < 4 else "a"])
        rows.append((i, rng.choice([" ", "\t\x0b", "\n"]).join(["w x"] * n), s))
    return rows + [(700, None, "a"), (701, "  ", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, s, "x", 1.0) for i, t, s in rows], SCHEMA)
    out = mixing.mix(df, [5.0, 2.0, 1.0]).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    want, sizes = brute_targets(rows, [5, 2, 1], 3)
    text = {i: t for i, t, _ in rows}
    taken, least = {}, {}
    for r in out:
        assert r.size == words(text[r.doc_id]) and r.taken == r.copies * r.size
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        if r.size:
            least[r.source] = min(least.get(r.source, 1 << 40), r.size)
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(1, least.get(s, 1))
    again = mixing.mix(df.repartition(7), [5.0, 2.0, 1.0]).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_rates_tilt_with_size(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 100)), "a" if i < 400 else "b") for i in range(800)]
    df = spark.createDataFrame([(i, t, s, "x", 1.0) for i, t, s in rows], SCHEMA)
    out = mixing.mix(df, [3.0, 1.0]).collect()
    mean = lambda s, n: sum(r.copies for r in out if r.source == s and r.size == n) / 200
    assert mean("a", 100) > mean("a", 10) >= 1 >= mean("b", 10) > mean("b", 100)


def test_one_source_equal_rows_and_empty_table(spark):
    rows = [(1, "a b", None, "x", 1.0)] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.taken for r in mixing.mix(df, [5.0]).collect()] == [2] * 5
    assert mixing.mix(df.limit(0), [5.0, 2.0]).collect() == []
    nothing = spark.createDataFrame([(1, None, "a", "x", 1.0)], SCHEMA)
    assert [(r.taken, r.target) for r in mixing.mix(nothing, [1.0]).collect()] == [(0, 0.0)]
