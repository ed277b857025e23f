"""Links and components against all cosines."""

import numpy as np
import pytest

from auditloom.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, n_links long"


def brute(rows, least=0.98):
    rows = [(i, None if v is None or l is None or i is None or len(v) != 8 else np.array(
        [np.nan if x is None else np.float32(x) for x in v], float), l) for i, v, l in rows]
    ok = [v is not None and np.isfinite(v).all() and (v != 0).any() for _, v, _ in rows]
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2]:
                a, b = rows[i][1], rows[j][1]
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    top[find(i)] = find(j)
    out = []
    for i, (k, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        c = min(ids) if k is not None else None
        out.append((k, n[i], c, k == c))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA)
    return sorted((tuple(r) for r in covertree.near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(covertree, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        centres = rng.normal(size=(12, 8))
        for c in centres:
            for _ in range(int(rng.integers(1, 9))):
                v = c + rng.normal(size=8) * rng.choice([0, 0.01, 0.12, 0.2]) * np.linalg.norm(c) / 3
                rows.append(((v * rng.choice([1, 3])).astype(np.float32).tolist(), label))
        rows += [(centres[0].astype(np.float32).tolist(), label)] * 5
        near = centres[1] + rng.normal(size=(60, 8)) * 1e-3
        rows += [(v.astype(np.float32).tolist(), label) for v in near]
    ids = rng.permutation(len(rows)).tolist()
    rows = [(i, *r) for i, r in zip(ids, rows)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    one, inf, nan = [1.0] * 8, float("inf"), float("nan")
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, one, None), (4, one, None), (5, None, 0), (6, [0.0] * 8, 0),
            (7, [0.0] * 8, 0), (8, [1.0] * 7 + [None], 0), (9, [1.0] * 7 + [nan], 0), (10, [inf] * 8, 0),
            (11, [1.0], 0), (12, [], 0), (13, [2.0] * 8, 0), (14, one, 1), (None, one, 0)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, rows[5:6]) == brute(rows[5:6])
