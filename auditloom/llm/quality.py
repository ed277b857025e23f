"""Quality scores by voting of the nearest labelled texts in a latent-semantic space.

Texts become weighted terms: hashed words, word shapes, and how much a text repeats itself. A
truncated decomposition of a bounded labelled sample gives the latent axes; the sample's latent
vectors are broadcast, every document is compared with all of them by blocked cosine
products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8

SAMPLE_ROWS = 2_000  # expected labelled rows of each class
WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS = 1_024, 896, 128
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
AXES, NEIGHBOURS, BLOCK = 48, 25, 512
HELD_WORDS = 300_000

_SHAPE = [(re.compile(r"[^\W\d_]*[^\W\d_A-ZÀ-Þ][^\W\d_]*"), "a"), (re.compile(r"[A-ZÀ-Þ]+"), "A"),
          (re.compile(r"\d+"), "0")]


def _shape(word: str) -> str:
    for pattern, mark in _SHAPE:
        word = pattern.sub(mark, word)
    return word[:12]  # the shape of a word, not its text


def _terms_of(word: str) -> tuple[int, int]:
    w = zlib.crc32(word.encode("utf-8", "replace")) % WORD_TERMS
    return w, WORD_TERMS + zlib.crc32(_shape(word).encode("utf-8", "replace")) % SHAPE_TERMS


def terms(text: bytes, held: dict[str, tuple[int, int]]) -> np.ndarray:
    """Weights of all terms of a whole text; zeros without words."""
    words = text.decode("utf-8", "replace").split()
    out = np.zeros(TERMS, np.float32)
    if not words:
        return out
    counts = Counter(words)
    at = []
    for w in counts:
        t = held.get(w)
        if t is None:
            if len(held) > HELD_WORDS:
                held.clear()
            t = held[w] = _terms_of(w)
        at.append(t)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    index = np.array(at)
    for k in (0, 1):
        out += np.bincount(index[:, k], n, TERMS).astype(np.float32)
    out = np.sqrt(out / len(words))
    size = int(min(15, np.log2(len(words))))
    again = sum(map(str.__eq__, words, words[1:])) / len(words)
    base = WORD_TERMS + SHAPE_TERMS
    for k, share in enumerate((len(counts) / len(words), again, n.max() / len(words))):
        out[base + 32 * k + int(min(31, 31 * share))] = 0.5
    out[base + 96 + size] = 0.25
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency
    axes: np.ndarray
    vectors: np.ndarray  # latent, of length 1
    votes: np.ndarray  # label and class weight
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        if not k:
            return out
        near = self.latent(x) @ self.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        similar = np.maximum(np.take_along_axis(near, top, axis=1), 0.0).astype(np.float64) ** 4
        weight = similar * self.votes[top, 1]
        total = weight.sum(axis=1)
        some = (total > 0) & x.any(axis=1)
        out[some] = (weight * self.votes[top, 0]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from about ``rows`` labelled documents of each class, chosen by hash.

    A key with several labels counts with their majority, 1 in a tie. Neighbours of a class
    weigh as much as the class has labelled rows, so that even samples do not shift the vote.
    Without labels every score is 0.5.
    """
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(
        (F.avg(label) >= 0.5).cast("int").alias("_y"))
    sizes = {r._y: r.n for r in told.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    chosen = told.where(draw < F.when(F.col("_y") == 1, rows / max(1, sizes.get(1, 0))).otherwise(
        rows / max(1, sizes.get(0, 0)))).limit(4 * rows)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x = [terms(t, held).tobytes() for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "y"])

    sample = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), key).select(text, "_y").mapInArrow(
        described, "x binary, y int").toPandas()  # at most 4 * rows keys
    y = sample["y"].to_numpy(np.float64) if len(sample) else np.zeros(0)
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, AXES), np.float32),
                     np.zeros((0, AXES), np.float32), np.zeros((0, 2)), prior)
    x = np.stack([np.frombuffer(b, np.float32) for b in sample["x"]])
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    _, axes = np.linalg.eigh((x * weights).T @ (x * weights))
    model = Model(weights, axes[:, ::-1][:, :AXES].astype(np.float32), np.zeros((0, AXES)), np.zeros((0, 2)), prior)
    model.vectors = model.latent(x).astype(np.float32)
    share = {c: sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    model.votes = np.stack([y, np.where(y == 1, share[1], share[0])], 1)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier). Null, empty and blank texts get the share
    of label 1; a column named ``score`` is replaced; equal texts get equal scores."""
    kept = docs.drop("score")
    at = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            texts, found = utf8(batch.column(at)), []
            for i in range(0, len(texts), BLOCK):
                x = np.stack([terms(t, held) for t in texts[i : i + BLOCK]])
                found.append(shared.value.score(x))
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, score double")
