"""Held-out accuracy, the backoff order and odd rows."""

import math
import os
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import language
from auditloom.llm.common import folds

SF = "/root/testdata/sf0.01"


def model_of(spark, rows):
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_words_before_grams_and_long_before_short(spark):
    model = model_of(spark, [("sol sol luna luna", "xx"), ("sun sun moon moon", "yy"), (None, "xx"), ("sol", None)])
    assert model["langs"] == ["xx", "yy"]
    words, logs = model["tables"][0]
    assert set(words) == {"sol", "luna", "sun", "moon"}
    assert (language.word_score(model, "sol") == logs[words["sol"]]).all()
    index, logs5 = model["tables"][5]
    assert (language.word_score(model, "unmoon")[1] > language.word_score(model, "unmoon")[0])
    assert (language.word_score(model, "solx") == model["tables"][4][1][model["tables"][4][0]["^sol"]]).all()
    assert not language.word_score(model, "ж").any()


def test_odd_rows(spark):
    model = model_of(spark, [("uno dos uno dos", "es"), ("one two one two", "en")])
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "uno " * 30_000), (5, "one"), (5, "one"), (None, "ж")]
    df = spark.createDataFrame([(i, t, "k", 2.0) for i, t in rows],
                               "doc_id long, text string, lang_pred string, score double")
    out = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in language.identify(df, model).collect()]
    assert out[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert [o[1] for o in out[3:6]] == ["es", "en", "en"] and out[4] == out[5]
    assert out[6][1:] == ("en", 0.5)  # nothing known: the language that sorts first
    assert language.identify(df.limit(0), model).collect() == []
    empty = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def test_letters_decide(spark):
    model = model_of(spark, [("uno dos uno dos", "es"), ("one two one two", "en"), ("दो तीन दो तीन", "hi")])
    rows = [(1, "½ ² ① 12_"), (2, "Ⅷ"), (3, "दो"), (4, "x²one½two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert got == {1: "und", 2: "und", 3: "hi", 4: "en"}
    assert language.words_of("दो é2é e\u0301a") == ["दो", "é", "é", "e\u0301a"]


def plain_words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha() or (word and unicodedata.category(c)[0] == "M"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(labelled, texts, longest=5):
    """Prediction by counting everything anew, with all words and n-grams that occur twice."""
    langs = sorted({x for _, x in labelled})
    pieces = lambda w, k: [w] if k == 0 else (
        list(w) if k == 1 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)] or [f"^{w}$"])
    counts = {(x, k): Counter() for x in langs for k in range(longest + 1)}
    for text, x in set(labelled):
        for w in plain_words(text):
            for k in range(longest + 1):
                counts[x, k].update(pieces(w, k))
    kept = [{g for x in langs for g in counts[x, k] if sum(counts[y, k][g] for y in langs) > 1}
            for k in range(longest + 1)]

    def log(x, k, g):
        return math.log((counts[x, k][g] + 0.5) / (counts[x, k].total() + 0.5 * (len(kept[k]) + 1)))

    def of_word(x, w):
        for k in [0, *range(min(longest, len(w) + 2), 0, -1)]:
            known = [g for g in pieces(w, k) if g in kept[k]]
            if known:
                return sum(log(x, k, g) for g in known) / len(known)
        return 0.0

    out = []
    for text in texts:
        words = plain_words(text or "")
        if not words:
            out.append(("und", 0.0))
            continue
        total = [sum(of_word(x, w) for w in words) for x in langs]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_same_as_a_plain_recomputation(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 4_000]
    labelled = [(r.text, r.lang) for r in rows[:80] if r.lang] * 2
    texts = [r.text[:n] for r in rows[80:] for n in (12, 30, 4_000)] + [None, "½", "zq", "ж"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(language.identify(df, model_of(spark, labelled)).collect())
    for r, (lang, score) in zip(got, brute(labelled, texts)):
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3, abs=1e-6)


def test_familiar_tells_unlearned_languages(spark):
    """Spanish and English prose stays familiar; Swedish, with the same letters, is not."""
    es = "el perro come la carne en la casa de su amigo y la mujer lee un libro en el parque con el niño "
    en = "the dog eats the meat in the house of his friend and the woman reads a book in the park with the child "
    sv = "hunden äter köttet i huset hos sin vän och kvinnan läser en bok i parken med barnet som springer fort "
    model = model_of(spark, [(es * 3, "es"), (en * 3, "en")])
    df = spark.createDataFrame([(1, es * 5), (2, en), (3, sv), (4, "hunden springer"), (5, sv * 50)], "doc_id long, text string")
    got = {r.doc_id: r.familiar for r in language.identify(df, model).collect()}
    assert got[1] > 0.8 and got[2] > 0.8 and got[4] > 0.5  # two words tell nothing
    assert got[3] < 0.25 and got[5] < 0.25


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs.where(folds()), language.fit(docs.where(~folds())))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


def test_known_words_are_never_scored_again(monkeypatch):
    scores = np.log(np.array([[0.9, 0.1], [0.2, 0.8]], np.float32))
    grams = [({}, np.zeros((0, 2), np.float32))] * language.LONGEST
    model = {"langs": ["a", "b"], "tables": [({"one": 0, "zwei": 1}, scores), *grams], "usual": [1.0, 1.0]}
    asked = []
    monkeypatch.setattr(language, "MEMO_WORDS", 4)
    monkeypatch.setattr(language, "word_score", lambda m, word: asked.append(word) or np.zeros(2, np.float32))
    scorer = language.Scorer(model)
    assert [scorer.predict(t)[0] for t in ("one x", "zwei y x", "one one", "zwei")] == ["a", "b", "a", "b"]
    assert asked == ["x", "y"]
