"""Neighbours against brute force: recall, exact scores, order and odd rows."""

import numpy as np

from auditloom.llm import rpforest

SCHEMA = "vec_id long, embedding array<float>, score string, rank long"


def brute(rows, query, k):
    ok = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    d = sorted((float(np.sqrt(((x - ok[query]) ** 2).sum())), i) for i, x in ok.items() if i != query)
    return d[:k]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[100]  # one vector many times: ties
    df = frame(spark, list(enumerate(x.tolist())))
    out = {}
    for r in rpforest.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(out) == set(range(0, 3000, 100))
    hit = 0
    for q, found in out.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        for _, score, v in found:
            a, b = x[q].astype(float), x[v].astype(float)
            assert score == np.sqrt(((a - b) ** 2).sum())
        hit += len({v for _, v in brute(list(enumerate(x)), q, 10)} & {f[2] for f in found})
    assert hit / (10 * len(out)) >= 0.9
    assert [f[2] for f in out[100]] == list(range(101, 111))


def test_blocks_of_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32).tolist())]
    df = frame(spark, rows)
    out = rpforest.neighbours(df, df.where("vec_id = 0"), k=7, share=1.0).orderBy("rank").collect()
    assert [(r.score, r.vec_id) for r in out] == brute(rows, 0, 7)


def test_odd_rows(spark):
    nan, one = float("nan"), [1.0, 0.0]
    rows = [(0, one), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]),
            (6, [1.0]), (7, []), (None, one), (8, [float("inf"), 0.0]), (200, [5.0, 0.0])]
    df = frame(spark, rows)
    out = rpforest.neighbours(df, df.where("vec_id % 100 = 0")).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)
    assert got == [(0, 1, 1, 1.0), (0, 2, 200, 4.0), (200, 1, 1, 3.0), (200, 2, 0, 4.0)]
    assert rpforest.neighbours(df.limit(0), df).collect() == []
    alone = df.where("vec_id = 0")
    assert rpforest.neighbours(alone, alone).collect() == []


def test_repeated_rows_of_a_near_key_leave_room_for_others(spark):
    rows = [(100, [1.0, 0.0])] + [(1, [1.0, 0.1])] * 12 + [(1, [1.0, 0.05 * i]) for i in range(3, 15)] + [
        (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = rpforest.neighbours(df, df.where("vec_id = 100"), 10, share=1.0).collect()
    assert sorted((r.rank, r.vec_id) for r in out) == [(1, 1), (2, 2), (3, 3)]
    assert min(r.score for r in out) == ((1.0 - 1.0) ** 2 + 0.1**2) ** 0.5
