"""Ranked lexical search by dense blocked matrix products.

Texts become postings over the items' vocabulary once. A task then takes some hundred documents
at a time, keeps the vocabulary they hold, and multiplies tiles of item weights with tiles of
document impacts in float64. A tile is cut so that its sums stay below 2^53; sums of tiles are
added as 64-bit integers, so scores are exact and ties are ties. Tasks return their best rows only.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import staged, utf8
from auditloom.operators.topk import first_per_group

ITEM_ROWS, ITEM_BYTES = 1_024, 4_000_000  # items searched together: their vocabulary is broadcast
TILE_DOCS, TILE_TERMS = 512, 2_048
POOL_ROWS = 200_000
IMPACT = 1_000_000  # every impact is below
EXACT = 2**53 // IMPACT  # weights of a tile add up to less

# fixed values: what parts terms, and the constants of weight and impact
SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same over UTF-8 bytes in lower case


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())  # bytes.lower: A-Z alone


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- postings -------------------------------------------------------------------------------------

_POSTINGS = "doc_id long, n long, ids array<int>, tfs array<int>"


def _postings(held):
    """Rows of documents with a term: all terms counted, those of the vocabulary listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(held.value)}
        for batch in batches:
            keep, n, ids, tfs = [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                found = terms(text)
                if found:
                    count = Counter(map(number.get, found))
                    count.pop(None, None)
                    keep.append(i), n.append(len(found))
                    ids.append(list(count.keys())), tfs.append(list(count.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32())),
            ], names=["doc_id", "n", "ids", "tfs"])

    return run


# --- scoring --------------------------------------------------------------------------------------


class Weights:
    """Item weights by term: entries start[t] to start[t + 1] of ``item`` and ``value``."""

    def __init__(self, counts: list[dict[int, int]], weights: list[int]):
        rows = sorted((t, i, c * weights[t]) for i, of in enumerate(counts) for t, c in of.items())
        self.items = len(counts)
        self.start = np.searchsorted([t for t, _, _ in rows], np.arange(len(weights) + 1))
        self.item = np.array([i for _, i, _ in rows], np.int64)
        self.value = np.array([v for _, _, v in rows], np.int64)
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, [t for t, _, _ in rows], self.value)

    def dense(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of terms, columns of items."""
        sizes = self.start[wanted + 1] - self.start[wanted]
        row = np.repeat(np.arange(len(wanted)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(self.start[wanted] - np.cumsum(sizes) + sizes, sizes)
        out = np.zeros((len(wanted), self.items), np.int64)
        out[row, self.item[at]] = self.value[at]
        return out


def _cuts(most: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of terms whose largest weights add up to less than ``limit``, or of one term."""
    out, start, load = [], 0, 0
    for i, v in enumerate(most.tolist()):
        if i > start and (load + v >= limit or i - start == TILE_TERMS):
            out.append((start, i))
            start, load = i, 0
        load += v
    return out + [(start, len(most))] if len(most) else []


def tile_scores(weights: Weights, doc: np.ndarray, term: np.ndarray, impact: np.ndarray,
                n_docs: int, limit: int = EXACT) -> np.ndarray:
    """Scores (item, document) of a tile of documents, whose entries are given."""
    scores = np.zeros((weights.items, n_docs), np.int64)
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    present, first = np.unique(term, return_index=True)
    edges = np.append(first, len(term))
    for a, b in _cuts(weights.most[present], limit):
        lo, hi = edges[a], edges[b]
        q = weights.dense(present[a:b])
        if b - a == 1 and weights.most[present[a]] >= limit:  # one term too heavy for doubles
            scores[:, doc[lo:hi]] += q[0][:, None] * impact[lo:hi][None, :]
            continue
        d = np.zeros((b - a, n_docs))
        d[np.searchsorted(present[a:b], term[lo:hi]), doc[lo:hi]] = impact[lo:hi]
        scores += (q.astype(np.float64).T @ d).astype(np.int64)
    return scores


class Best:
    """The k best documents of every item so far; ties to smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])  # ties with the last one stay in
        self.rows.append((item, ids[doc], scores[item, doc]))
        self.held += len(item)
        if self.held > POOL_ROWS:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, ids, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -score, item))
        item, ids, score = item[order], ids[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[item[full]] = score[full]
        self.rows = [(item[keep], ids[keep], score[keep])]
        self.held = int(keep.sum())
        return self.rows[0]


def _scored(held, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        best = Best(weights.items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                sizes = np.asarray(part.column(2).value_lengths())
                doc = np.repeat(np.arange(part.num_rows), sizes)
                n = np.asarray(part.column(1)).astype(np.int64)
                m = (75 + 25 * n * n_docs // n_terms)[doc]
                tf = np.asarray(part.column(3).flatten()).astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                term = np.asarray(part.column(2).flatten()).astype(np.int64)
                best.add(tile_scores(weights, doc, term, impact, part.num_rows), np.asarray(part.column(0)))
        if best.rows:
            item, ids, score = best.cut()
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
                names=["no", "doc_id", "score"])

    return run


# --- operator -------------------------------------------------------------------------------------


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with a ``block``: at most ITEM_ROWS rows and ITEM_BYTES bytes, or one item."""
    told = items.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n = max(1, -(-told.n // ITEM_ROWS), -(-(told.size or 0) // ITEM_BYTES))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
        over = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where(
            (F.col("n") > 1) & ((F.col("n") > ITEM_ROWS) | (F.col("size") > ITEM_BYTES)))
        if n == 1 or over.isEmpty():
            return dealt, n
        n *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item, score above 0.

    Equal scores rank by smaller document key. Every document row counts in the statistics, repeated
    rows too; rows with a null key are in the statistics only. Null, empty and term-free texts
    match nothing. Repeated items count once; items that share a key but not the text are ranked
    each on its own, under the same key. Empty tables give no rows; other columns are not read. Keys are longs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = staged(items.select(
        F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"),
        F.coalesce(F.octet_length(item_text), F.lit(0)).cast("long").alias("size"),
    ).where("text is not null").distinct(), "items")
    asked, blocks = _blocks(asked)
    out = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).collect()  # ITEM_ROWS and ITEM_BYTES, or one
        lists = [Counter(terms(r.text.encode())) for r in rows]
        words = sorted(set().union(*lists)) if lists else []
        number = {w: i for i, w in enumerate(words)}
        postings = staged(
            docs.mapInArrow(_postings(spark.sparkContext.broadcast(words)), _POSTINGS), "postings")
        all_ = postings.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = dict.fromkeys(range(len(words)), 0)  # one number per word of the block
        for r in postings.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weights = Weights([{number[w]: c for w, c in of.items()} for of in lists],
                          [weight(all_.n, df[i]) for i in range(len(words))])
        found = postings.where(F.col("doc_id").isNotNull() & (F.size("ids") > 0)).mapInArrow(
            _scored(spark.sparkContext.broadcast(weights), all_.n, all_.l or 1, k),
            "no int, doc_id long, score long")
        best = first_per_group(found, ["no"], [F.desc("score"), F.asc("doc_id")], k, ["doc_id"], rank_col="rank")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "no int, item_id long")
        best = best.join(names, "no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.union(best)
    return out


def ranked_sql(k: int = 20) -> str:
    """The same over ``documents`` and ``benchmark`` in DuckDB."""
    split = "regexp_extract_all(translate({}, '%s', '%s'), '%s')" % (
        string.ascii_uppercase, string.ascii_lowercase, SEPARATORS)
    return f"""
    WITH words AS (SELECT doc_id, unnest({split.format('text')}) AS term FROM documents),
    per_doc AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM per_doc),
    wanted AS (
      SELECT item_id, term, count(*) AS c
      FROM (SELECT item_id, unnest({split.format('text')}) AS term FROM benchmark) GROUP BY ALL
    ),
    tf AS (
      SELECT doc_id, term, count(*) AS tf FROM words
      WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
    ),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weights AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM df, totals
    ),
    scores AS (
      SELECT item_id, doc_id, sum(
        c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // len))))::BIGINT AS score
      FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN per_doc USING (doc_id), totals
      GROUP BY ALL
    ),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= {k}
    """
