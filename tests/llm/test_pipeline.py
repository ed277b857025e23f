"""The pipeline stage by stage against plain Python on a small table."""

import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from auditloom.llm.queries import MIX_MOST, MIX_WEIGHTS, PIECE_MODEL
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_suffixes import brute as removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)
    known = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(300)]
             for lang, letters in (("xx", "abcdefg"), ("yy", "klmnopq"))}
    prose = lambda lang, n: " ".join(rng.choice(known[lang]) for _ in range(n))
    passage = prose("xx", 120)
    rows, doc = [], 0
    for _ in range(80):
        lang = rng.choice(["xx", "yy"])
        text = prose(lang, rng.choice([3, 30, 150]))
        if rng.random() < 0.2:
            text = passage + "\n" + prose("xx", 300)
            lang = "xx"
        for _ in range(rng.choice([1, 1, 1, 3])):
            rows.append((doc, text if rng.random() < 0.7 else text + " end", lang, rng.choice("abc"), len(text)))
            doc += 1
    return rows + [(doc, None, "xx", "a", 0), (doc + 1, "12 34 !!", None, None, 8), (doc + 2, "", "yy", "b", 0)]


def test_stages_against_plain_python(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    languages, distinct, cut, mixed, tokens = seen
    assert all(d.columns == COLUMNS for d in seen[:-1])

    by_id = {r[0]: r for r in rows}
    known = {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {r.doc_id: tuple(r) for r in languages.collect()} == {i: by_id[i] for i in known}

    kept = {k for k, _, c in components([(i, by_id[i][1]) for i in sorted(known)]) if k == c}
    assert {r.doc_id: tuple(r) for r in distinct.collect()} == {i: by_id[i] for i in kept}

    order = sorted(kept)
    sizes = removed([by_id[i][1] for i in order], 400)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert [len(text[i].encode()) for i in order] == [s[0] - s[1] for s in sizes]
    assert any(s[1] for s in sizes)

    given = Counter(r.doc_id for r in mixed.collect())
    want, _ = brute_targets([(i, text[i], by_id[i][3]) for i in order], MIX_WEIGHTS, MIX_MOST)
    for source, target in want.items():
        own = [i for i in order if by_id[i][3] == source]
        least = min((words(text[i]) for i in own if words(text[i])), default=1)
        assert abs(sum(given[i] * words(text[i]) for i in own) - target) <= least
    assert max(given.values()) <= MIX_MOST

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    out = tokens.collect()
    assert Counter(r.doc_id for r in out) == given
    assert all(r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_repeated_passages_of_51_short_words_go(spark, tmp_path):
    rng = random.Random(6)
    word = lambda least, most: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(least, most)))
    prose = lambda n: " ".join(word(6, 12) for _ in range(n))
    passages = {
        "tiny": [word(1, 2) for _ in range(51)], "short": [word(2, 6) for _ in range(51)],
        "few": [word(4, 6) for _ in range(50)],
    }
    rows = [(i, prose(200) + "\n" + " ".join(p) + "\n" + prose(200), "xx", "a", 0)
            for i, p in enumerate(p for p in passages.values() for _ in range(2))]
    out = corpus_pipeline.repeat_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    text = {r.doc_id: r.text for r in out.collect()}
    for i, p in enumerate(passages.values()):
        for doc in (2 * i, 2 * i + 1):
            assert (" ".join(p[1:-1]) in text[doc]) == (len(p) < 51)
            assert len(text[doc].split()) >= 399
