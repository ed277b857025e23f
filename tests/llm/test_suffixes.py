"""Removed bytes against brute force over all windows, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import suffixes


def brute(texts, size):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int(((gone[1:] != gone[:-1]) & gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, size):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, kept string, tk long")
    rows = suffixes.remove_repeats(df, size).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), "spans", F.sha2("kept", 256)
    ).orderBy("doc_id").collect()
    return [(r[1], sum(s.end - s.start for s in r[2]), len(r[2]), r[3]) for r in rows]


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(size // 3), prose(size // 2)
    texts = [None, "", "short", prose(900) + passage]
    for _ in range(30):
        parts = [prose(rng.randrange(5, 400))]
        for p in (passage, other):
            if rng.random() < 0.5:
                cut = rng.choice([0, 0, 40])
                parts.insert(rng.randrange(2), p[cut : len(p) - rng.choice([0, 0, 60])])
        texts.append("".join(parts))
    base = prose(500)
    for _ in range(25):
        at = rng.randrange(len(base) - 5)
        texts.append(base[:at] + word() + base[at + 3 :])
    return texts + [texts[5], texts[5], "ab" * 700, "the " * 300, prose(3), passage * 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # hot anchors, several shards and pieces of texts
        monkeypatch.setattr(suffixes, "HOT_COPIES", 3)
        monkeypatch.setattr(suffixes, "HOT_REGIONS", 3)
        monkeypatch.setattr(suffixes, "SHARD_BYTES", 40_000)
        monkeypatch.setattr(suffixes, "PIECE_BYTES", 1_000)
    texts = corpus(seed, 400)
    assert got(spark, texts, 400) == brute(texts, 400)


def test_nothing_to_find(spark):
    assert got(spark, [], 400) == []
    assert got(spark, [None, "", "a"], 400) == brute([None, "", "a"], 400)


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_sorts_suffixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 400)).astype(np.uint8)
    order = suffixes.suffix_array(data, suffixes._words(data, 16))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tobytes())


def test_short_windows_have_few_regions(spark):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    found = sum(len(part[0]) for part in suffixes.regions([text.encode()], 101))
    assert found < 60_000 * 2 / 50  # grams of 64 bytes make 2 / 39 a byte
    texts = [text[:3000], text[2899:5000], text[2900:6000], text[4000:4101], text[9000:9100]]
    assert got(spark, texts, 101) == brute(texts, 101)
