"""Kept lines against a plain recount, odd rows, and the DuckDB form."""

import random

from auditloom.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, _gone long, line string"


def key(line):
    out = line.strip(" \t\n\r\x0b\x0c")
    return "".join(c.lower() if c.isascii() else c for c in out)


def brute(rows, docs=2, chars=10):
    """Documents by id; a null id comes last."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, t in rows:
        kept, all_lines = [], (t or "").split("\n")
        for line in all_lines:
            k = key(line)
            if len(k) < chars or len(holders[k]) < docs or min(holders[k]) == (i is None, i or 0):
                kept.append(line)
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], SCHEMA)
    out = lines.drop_repeated(df, **options)
    assert out.columns == ["doc_id", "text", "_gone", "line", "n_lines", "n_dropped", "kept"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["a line of words %d" % i for i in range(30)] + [
        "", "short", "  exactly10  ", "exactly10", "exactly 10", "ÀÉ über Maß", "àé über maß", "\tTabbed Line\r",
        "tabbed line", "Tabbed line\x0b", "line kept apart ", "日本語の十文字以上の行です", "a+b.*[x](regex)"]
    rows = []
    for i in range(120):
        text = "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 9])))
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


def test_equals_a_plain_recount(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_docs=5, least_chars=3) == brute(rows, 5, 3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "shared by the nameless"), (None, "shared by the nameless\nmore"),
            (3, "shared by the nameless"), (4, "one line that repeats\nother\none line that repeats"),
            (5, "ONE line that repeats \n"), (5, "ONE line that repeats \n"), (5, "a second version\none line that repeats"),
            (6, "\n\n\n"), (7, "one line that repeats")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


def test_a_very_long_text_and_a_line_of_all(spark):
    long = "\n".join("the line that everybody has" if i % 2 else f"line number {i} of the text" for i in range(60_000))
    rows = [(i, "the line that everybody has\nown line of %d" % i) for i in range(2_000)] + [(2_000, long)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert max(r[2] for r in got) == 30_000
