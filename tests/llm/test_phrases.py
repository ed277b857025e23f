"""Collocations against a plain recount, the quicksort alone, and odd rows."""

import random
import re
from collections import Counter

import numpy as np

from auditloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, c long"


def brute(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and a >= counts[p[i:j]]:
                        covered.add(p[i:j])
        told = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
                for i, (s, a, p, x, y) in enumerate(sorted(told)[:top])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, x, "p", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def corpus(seed, docs=250):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "in", "Über", "über", "日本", "x's", "-"] + ["w%d" % i for i in range(25)]
    passage = "a fixed passage of seven words here"
    rows = []
    for _ in range(docs):
        parts = [passage if rng.random() < 0.1 else rng.choice(words[: rng.choice([4, 34])]) for _ in range(60)]
        text = parts[0]
        for p in parts[1:]:
            text += rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) + p
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


def test_equals_a_plain_recount(spark):
    rows = corpus(1)
    for least in (5, 20):
        assert run(spark, rows, least=least) == brute(rows, least)
    assert run(spark, rows, least=5, longest=3, top=7) == brute(rows, 5, 3, 7)


def test_hot_beginnings_are_routed_by_more_words(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(phrases, "HOT_ROWS", 30)
    monkeypatch.setattr(phrases, "HOT_PARTS", 100)
    monkeypatch.setattr(phrases, "FLUSH_ROWS", 300)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 10)
    monkeypatch.setattr(phrases, "FLUSH_PAIRS", 10)
    assert run(spark, rows, least=8) == brute(rows, 8)


def test_colliding_hashes_are_hashed_anew(spark, monkeypatch):
    rows, plain = corpus(3, 60), phrases._lang_hash
    docs = spark.createDataFrame([(x or "und", t) for t, x in rows], "lang string, text string")
    assert phrases._word_counts(docs)[2] == 0
    monkeypatch.setattr(phrases, "_lang_hash", lambda x, seed: 7 if seed == 0 else plain(x, seed))
    assert phrases._word_counts(docs)[2] == 1


def test_quicksort_counts():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, (3000, 5)).astype(np.uint64)
    for i in range(2, 5):
        words[rng.random(3000) < 0.2, i:] = 0
    counts = rng.integers(1, 9, 3000)
    want = Counter()
    for w, c in zip(words.tolist(), counts.tolist()):
        for d in range(2, 6):
            if w[d - 1]:
                want[tuple(w[:d])] += c
    for least in (1, 200):
        got = {tuple(words[i, :d].tolist()): c for i, d, c in phrases.quicksort(words, counts, least)}
        assert got == {p: c for p, c in want.items() if c >= least}
    got = {tuple(words[i, :d].tolist()): c for i, d, c in phrases.quicksort(words, counts, 10**9, 4)}
    assert got == {p: c for p, c in want.items() if len(p) < 4}


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "de"), ("a b", None), ("A\tB. a b", "und")] * 3
    rows += [("one two " * 30_000, "long"), ("x " * 300_000, "long"), ("wide. " * 400_000, "cut")]
    assert run(spark, rows, least=4) == brute(rows, 4)
    assert run(spark, [], least=1) == run(spark, [("", "en")], least=1) == []


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000 as a", "9000000000000 as n", "8999999999999 as l", "9000000000000 as r")
    wide = "cast({} as decimal(18, 0))"
    got = row.selectExpr(f"(1000 * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')}) as s")
    assert got.first().s == 1000 * 9 * 10**12 * 9 * 10**12 // (8999999999999 * 9 * 10**12)
