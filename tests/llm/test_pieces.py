"""Ids against the sentencepiece library, and round trips."""

import random

import pytest
import sentencepiece

from auditloom.llm import pieces
from auditloom.llm.queries import PIECE_MODEL

ODD = ["", " ", "  ", "a", " a  b   c    d     e", "line\nbreak\ttab", "été naïve 日本語 🙂🙂", "\u0000x",
       "The end.</s><s> <unk> <0x0A>", "x" * 3000, "ab" * 700 + " y", "....!!!!", "1234567890" * 20,
       "thethethe the  the", "A B　C"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_ids_as_the_library(model, library):
    rng = random.Random(3)
    letters = "etaoinshrdlu ETA  éü.,'-\n0159日▲"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    assert pieces.encode(model, texts, {}) == library.encode(texts)
    assert [pieces.decode(model, k) for k in library.encode(texts)] == texts


def test_long_and_short_words_agree(model, monkeypatch):
    words = ["▁" + w for t in ODD for w in t.split()]
    whole = pieces.encode(model, words, {})
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert pieces.encode(model, words, {}) == whole


def test_table(spark, model, library):
    rows = [(i, t, [1], "x") for i, t in enumerate([None, *ODD, ODD[4], ODD[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    out = pieces.decoded(pieces.encoded(df, model), model).orderBy("doc_id").collect()
    assert [r.ids for r in out] == library.encode([r[1] or "" for r in rows])
    assert [r.decoded for r in out] == [r[1] or "" for r in rows]
    assert all(r.round_trip for r in pieces.encoded(df, model, verify=True).collect())
    assert pieces.decoded(pieces.encoded(df.limit(0), model), model).collect() == []


def test_words_met_again_outlast_a_full_table(model, library, monkeypatch):
    learned, learn = [], pieces.Words.learn
    monkeypatch.setattr(pieces, "HELD_WORDS", 60)
    monkeypatch.setattr(pieces.Words, "learn",
                        lambda self, m, words: (learned.extend(words), learn(self, m, words))[1])
    held, most = {}, 0
    for i in range(30):
        usual = " ".join(f"usual{k}" for k in range(20) if (i + k) % 2)  # in every second call
        texts = [usual, " ".join(f"naïve{i}x{k}" for k in range(15)), ""]
        assert pieces.encode(model, texts, held) == library.encode(texts)
        most = max(most, len(held["words"].number))
    assert learned.count("▁usual5") == 1 and learned.count("▁naïve3x4") == 1 and most <= 60
    many = [" ".join(f"w{k}" for k in range(100)) + " usual5"]  # more than a table's words in one call
    assert pieces.encode(model, many, held) == library.encode(many)
    assert pieces.encode(model, many, held) == library.encode(many)
