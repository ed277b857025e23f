"""Language identification by known words first, then by ever shorter character n-grams.

Counts per language are learned from a bounded, documented sample of labelled texts. A known
word scores with its log frequency in each language. An unseen word scores with its longest
n-grams that were learned, from LONGEST letters down to one, averaged over the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import staged

SAMPLE_ROWS = 6_000  # expected labelled rows per language that the counts come from
MOST_LANGUAGES = 500  # languages of a model
KEPT_WORDS = 60_000  # known words: the most frequent ones
KEPT_GRAMS = 60_000  # known n-grams of each length
LONGEST = 5
DOUBT = 2.0  # known words that a text is given for being short
UNDETERMINED = "und"

MEMO_WORDS = 100_000  # words whose scores a task remembers
READ_ROWS = 500

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # marks belong to the letter before them


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; those longer than one letter see the word's edges."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] or ([marked] if n > 1 else [])


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` different texts (text, lang) of each of the MOST_LANGUAGES languages with most
    texts, chosen by hash of the text, copies once. Only chosen texts leave their place."""
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(
        F.desc("n"), "lang")
    kept = sizes.limit(MOST_LANGUAGES).collect()
    if not kept:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for r in kept for x in (r.lang, min(1.0, rows / r.n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.where(draw < F.element_at(share, F.col("lang"))).distinct()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, words: int = KEPT_WORDS,
        grams: int = KEPT_GRAMS) -> dict:
    """Model: languages, and for words and each n-gram length the log frequency per language.

    Counting runs on the executors over whole texts of the sample; the model holds at most
    ``words`` words and ``grams`` n-grams of each length, whatever the corpus.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows_ = []
            for lang, held in seen.items():
                for word, n in held.items():
                    rows_.append((lang, 0, word, n))
                grams_: list[Counter] = [Counter() for _ in range(LONGEST + 1)]
                for word, n in held.items():
                    for k in range(1, LONGEST + 1):
                        for g in grams_of(word, k):
                            grams_[k][g] += n
                rows_ += [(lang, k, g, n) for k in range(1, LONGEST + 1) for g, n in grams_[k].items()]
            seen.clear()
            cols = list(zip(*rows_)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                ["lang", "k", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > 200_000:
                    yield flush()
        yield flush()

    counts = staged(
        sample(labelled, rows).mapInArrow(counted, "lang string, k int, gram string, n long")
        .groupBy("k", "gram", "lang").agg(F.sum("n").alias("n")),
        "grams",
    )
    per_gram = counts.groupBy("k", "gram").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    )  # one entry per language
    kept = []
    for k in range(LONGEST + 1):
        top = per_gram.where((F.col("k") == k) & (F.col("total") >= 2)).orderBy(
            F.desc("total"), "gram").limit(words if k == 0 else grams)
        kept.append(top.select("gram", "by").collect())
    told = counts.groupBy("lang", "k").agg(
        F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    totals = {(r.lang, r.k): r.n for r in told}
    once = {r.lang: r.once for r in told if r.k == 0}
    langs = sorted({lang for lang, _ in totals})
    tables = []
    for k, held in enumerate(kept):
        size = np.array([totals.get((lang, k), 0) for lang in langs], float) + 0.5 * (len(held) + 1)
        n = np.full((len(held), len(langs)), 0.5)
        at = {lang: i for i, lang in enumerate(langs)}
        for row, r in enumerate(held):
            for lang, count in r.by.items():
                n[row, at[lang]] += count
        tables.append(({r.gram: i for i, r in enumerate(held)},
                       np.log(n / size).astype(np.float32) if langs else n))
    # the share of a language's words that are new to the model, by the share of words seen once
    # and of those left out
    size = {lang: totals.get((lang, 0), 0) for lang in langs}
    in_table = Counter()
    for r in kept[0]:
        in_table.update(r.by)
    usual = [max(0.0, min(1 - once.get(x, 0) / max(1, size[x]), in_table[x] / max(1, size[x]))) for x in langs]
    return {"langs": langs, "tables": tables, "usual": usual}


def word_score(model: dict, word: str) -> np.ndarray:
    """Log frequency per language: the word's own, else that of its longest known n-grams."""
    index, logs = model["tables"][0]
    row = index.get(word)
    if row is not None:
        return logs[row]
    for n in range(min(LONGEST, len(word) + 2), 0, -1):
        index, logs = model["tables"][n]
        rows = [i for g in grams_of(word, n) if (i := index.get(g)) is not None]
        if rows:
            return np.add.reduce(logs.take(rows, axis=0)) / np.float32(len(rows))
    return np.zeros(len(model["langs"]), np.float32)


class Scorer:
    """Predictions of a model. Its words keep their scores; those of other words are remembered
    behind them, in one array of fixed size, until it is full."""

    def __init__(self, model: dict):
        self.model, self.place = model, {}
        index, logs = model["tables"][0]
        self.own = len(index)
        shape = (self.own + MEMO_WORDS, len(model["langs"]))
        self.scores, self.known = np.zeros(shape, np.float32), np.zeros(shape, bool)
        if self.own:
            self.scores[: self.own] = logs
            self.known[: self.own] = logs > logs.min(axis=0) + 1e-6  # the least: a language lacks the word

    def _rows(self, words: list[str]) -> list[int]:
        if len(self.place) + len(words) > MEMO_WORDS:
            self.place.clear()
        out = list(map(self.model["tables"][0][0].get, words))
        if None in out:
            place = self.place
            for i, at in enumerate(out):
                if at is None:
                    word = words[i]
                    at = place.get(word)
                    if at is None:
                        at = place[word] = self.own + len(place)
                        self.scores[at] = word_score(self.model, word)
                    out[i] = at
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, posterior, and the text's share of that language's known words against its
        usual share, from 0; texts of a few words are given the doubt."""
        found = words_of(text) if text else []
        langs = self.model["langs"]
        if not found or not langs:
            return UNDETERMINED, 0.0, 0.0
        counts = Counter(found)
        words, times = list(counts), np.array(list(counts.values()), float)
        total, known = np.zeros(len(langs)), np.zeros(len(langs))
        for at in range(0, len(words), MEMO_WORDS // 2):
            rows = self._rows(words[at : at + MEMO_WORDS // 2])
            n = times[at : at + MEMO_WORDS // 2]
            total += n @ self.scores[rows].astype(float)
            known += n @ self.known[rows]
        best = int(total.argmax())
        posterior = 1 / np.exp(np.clip(total - total[best], -700, 0)).sum()
        usual = self.model["usual"][best] * len(found)
        return langs[best], float(posterior), float((known[best] + DOUBT) / usual) if usual else 1.0


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``; ``score``, the posterior of that language over the whole text; and
    ``familiar``, how much of the language's known words the text has, 1 being usual for it.

    Null texts and texts without a letter give ``und`` and 0, as does a model that saw no
    labelled row. In a tie the language that sorts first wins. Columns of these names are
    replaced. The model is broadcast; its size is bounded by the fit's parameters.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "familiar")
    at = kept.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for batch in (whole.slice(i, READ_ROWS) for i in range(0, whole.num_rows, READ_ROWS)):
                found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())],
                    [*batch.schema.names, "lang_pred", "score", "familiar"])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(scored, f"{fields}, lang_pred string, score double, familiar double")
