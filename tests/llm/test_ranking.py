"""Ranked search against a plain scorer, tile bounds, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from auditloom.llm import ranking

DOCS = "doc_id long, text string, score string, item_id long, rank int"
ITEMS = "item_id long, text string, doc_id string"


def split(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        want, scores = Counter(split(text)), []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // length
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in want.items() if b[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ranking.ranked(d, q, **options).collect()), key=str)


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(80)] + ["Été", "été", "ÜBER", "日本語", "x_y", "a-b", "42"]
    text = lambda: rng.choice([" ", ", "]).join(
        rng.choice(words[: rng.choice([5, 30, 87])]) for _ in range(rng.choice([1, 4, 4, 30, 200])))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]
    return docs, [(i, text()) for i in range(25)]


def test_equals_a_plain_scorer(spark, monkeypatch):
    docs, items = corpus(1)
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(ranking, "ITEM_ROWS", 7)  # several blocks of items
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?! _"), (None, "rare words here"), (4, "rare Words"), (5, "words"), (5, "words"),
            (6, "other"), (7, "very long " + "filler " * 300_000 + "rare")]
    items = [(1, "RARE words words"), (1, "RARE words words"), (1, "other"), (2, None), (3, ""), (None, "rare")]
    got = run(spark, docs, items)
    assert got == brute(docs, [(i, t) for i, t in items if t is not None])
    assert run(spark, [], items) == run(spark, docs, []) == []


def test_tiles_are_cut_below_the_bound_and_exact():
    rng = np.random.default_rng(3)
    terms, items, docs = 300, 6, 40
    values = rng.integers(1, 2**30, terms).tolist()
    counts = [{int(t): int(rng.integers(1, 2**12)) for t in rng.choice(terms, 90, False)} for _ in range(items)]
    weights = ranking.Weights(counts, values)
    term = np.concatenate([rng.choice(terms, 50, False) for _ in range(docs)])
    doc, impact = np.repeat(np.arange(docs), 50), rng.integers(1, ranking.IMPACT, 50 * docs)
    want = np.zeros((items, docs), np.int64)
    for d, t, x in zip(doc, term, impact):
        for i, of in enumerate(counts):
            want[i, d] += of.get(int(t), 0) * values[t] * int(x)
    assert (ranking.tile_scores(weights, doc, term, impact, docs) == want).all()
    cuts = ranking._cuts(weights.most, ranking.EXACT)
    assert all(b - a == 1 or weights.most[a:b].sum() < ranking.EXACT for a, b in cuts) and len(cuts) > 1


def test_ties_across_tiles_go_to_smaller_ids():
    best = ranking.Best(1, 3)
    rng = np.random.default_rng(0)
    ids = rng.permutation(100_000)
    for part in np.split(ids, 100):
        best.add(np.where(part[None, :] % 2 == 0, 7, 5), part)
        if part[0] % 3 == 0:
            best.cut()
    assert best.cut()[1].tolist() == [0, 2, 4]
