"""Licence matches against comparison with every template, and the SQL form."""

import random
from collections import Counter

from auditloom.llm import licences
from auditloom.llm.queries import QUERIES, SQL
from tests.oracle_check import difference, duck


def brute(rows, least=licences.LEAST):
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        for at, passage in enumerate([text if len(lines) > 1 else "", *lines]):
            a = licences.bigrams(licences.words_of((passage or "").encode()))
            hits = []
            for name, body in licences.TEMPLATES:
                b = licences.bigrams(licences.words_of(body.encode()))
                dice = 2 * (a & b).total() / max(1, a.total() + b.total())
                if a and dice >= least:
                    hits.append((-dice, name))
            if hits:
                out.append((doc, at, min(hits)[1], -min(hits)[0]))
    return Counter(out)


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "Released under the MIT License."), (4, "é " * 50_000)]
    for i in range(300):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licences.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["a", "b", "the the"])
            lines.append(rng.choice(["", "// ", "x y z "]) + " ".join(words).swapcase())
        rows.append((i, "\n".join(lines)))
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, licence string, score double")
    assert Counter(map(tuple, licences.scan(df).collect())) == brute(rows)
    assert licences.scan(df.limit(0)).collect() == []


def test_sql_form(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, QUERIES["op8_licence_scan"], SQL["op8_licence_scan"], sf, duck(sf)) is None
