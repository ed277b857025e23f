"""Phrase collocation mining by multikey quicksort of suffix pointers.

Every word position that can begin a frequent phrase is a pointer to the next words. Pointers are
routed over all tasks by their leading words, so that a task holds every pointer that begins alike;
there a three-way quicksort, word by word down to the longest phrase, parts them. Partitions of
equal words are phrases and their sizes the counts; a partition that is too small is given up at
once, since no other task can add to it. Leading words that are very frequent are routed by more
words, and only their few prefixes are summed over tasks.

Words are 64-bit hashes of (language, word). The hashes of all words of the corpus are compared
with a second hash; should two words ever meet, everything is hashed anew with another seed.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import mix, powers, slices, staged, table_bits, utf8
from auditloom.operators.topk import first_per_group

LONGEST, LEAST, TOP = 5, 100, 2_000
READ_ROWS, SLICE_BYTES = 500, 500_000  # texts taken from a batch, and hashed, together
FLUSH_WORDS, FLUSH_PAIRS, FLUSH_ROWS = 400_000, 300_000, 200_000
BUCKET_ROWS = 300_000  # pointers of one quicksort, about
HOT_ROWS, HOT_PARTS = 300_000, 1_000  # leading words with more pointers, or a thousandth, go by more words
BITS = 26  # filters have 2^26 bits: 8 MB, whatever the number of frequent words
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int8)  # 0: of a word, 1: blank, 2: ends a piece
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_ODD = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(8)]


# --- words of texts -------------------------------------------------------------------------------


class Words:
    """Words of some texts in a row: hash, place, and whether the next word is in the same piece."""

    def __init__(self, texts: list[bytes], langs: list[bytes], seed: int):
        self.data = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[self.data]
        turn = np.diff((kind == 0).astype(np.int8))
        self.start, self.end = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
        up, down = powers(len(self.data) + 1)
        byte = mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * _ODD[0])
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(byte[self.data] * up[: len(self.data)], out=sums[1:])
        plain = (sums[self.end] - sums[self.start]) * down[self.start]
        firsts = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
        self.text = np.searchsorted(firsts, self.start, side="right") - 1
        tongue = np.array([_lang_hash(x, seed) for x in langs], np.uint64)
        self.hash = mix(mix(plain) + tongue[self.text]) | np.uint64(1)  # 0 is no word
        piece = np.cumsum(kind == 2)[self.start]
        self.next = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _lang_hash(lang: bytes, seed: int) -> int:
    out = seed + 1
    for b in lang + b"\xff":
        out = (out * int(_ODD[1]) + b + 1) % (1 << 64)
    return out


def _parts(text: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text cut where pieces end anyway, into parts of about ``limit`` bytes."""
    while len(text) > limit:
        ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, offset=limit)] == 2)
        if not len(ends):
            break
        yield text[: limit + int(ends[0])]
        text = text[limit + int(ends[0]) :]
    yield text


def _read(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[bytes]]]:
    for rows in (batch.slice(at, READ_ROWS) for batch in batches for at in range(0, batch.num_rows, READ_ROWS)):
        texts, langs = [], []
        for lang, text in zip(utf8(rows.column(0)), utf8(rows.column(1))):
            for part in _parts(text):
                texts.append(part), langs.append(lang)
        for a, b in slices(texts, SLICE_BYTES):
            yield Words(texts[a:b], langs[a:b], seed), langs[a:b]


# --- counts of words and of leading pairs -----------------------------------------------------------

_WORDS = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])
_HEADS = pa.schema([("p", pa.int64()), ("c", pa.int64())])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _counted(seed: int):
    """Different words with their counts; a word may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        spelled: list[tuple[bytes, bytes]] = []  # in the order of first sight
        seen_at = np.zeros(0, np.int64)

        def rows():
            order = [spelled[i] for i in seen_at.tolist()]
            return pa.RecordBatch.from_arrays([
                pa.array(_signed(known)), pa.array([x.decode() for x, _ in order], pa.string()),
                pa.array([w.decode() for _, w in order], pa.string()), pa.array(counts)], schema=_WORDS)

        for words, langs in _read(batches, seed):
            h, first, c = np.unique(words.hash, return_index=True, return_counts=True)
            at = np.searchsorted(known, h)
            old = at < len(known)
            old[old] = known[at[old]] == h[old]
            counts[at[old]] += c[old]
            new = np.flatnonzero(~old)
            places = len(spelled) + np.arange(len(new))
            spelled += [(langs[words.text[i]], words.word(i)) for i in first[new].tolist()]
            known = np.insert(known, at[new], h[new])
            counts = np.insert(counts, at[new], c[new])
            seen_at = np.insert(seen_at, at[new], places)
            if len(known) > FLUSH_WORDS:
                yield rows()
                known, counts, seen_at, spelled = known[:0], counts[:0], seen_at[:0], []
        if len(known):
            yield rows()

    return run


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def _linked(words: Words, frequent: np.ndarray) -> np.ndarray:
    """Whether a word and its successor are frequent and in one piece."""
    common = _has(frequent, words.hash)
    return words.next & common & np.append(common[1:], False)


def _heads(words: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the first ``depth`` words of every row."""
    h = np.full(len(words), depth, np.uint64)
    for i in range(depth):
        h = mix((h + words[:, i]) * _ODD[2 + i % 2])
    return h


def _pointers(words: Words, linked: np.ndarray, longest: int) -> np.ndarray:
    """Rows of hashes: the words from every linked position on, 0 behind the last linked one."""
    at = np.flatnonzero(linked)
    out = np.zeros((len(at), longest), np.uint64)
    out[:, 0], out[:, 1] = words.hash[at], words.hash[at + 1]
    on = np.ones(len(at), bool)
    for i in range(2, longest):
        on &= linked[np.minimum(at + i - 1, len(linked) - 1)]
        out[on, i] = words.hash[at[on] + i]
    return out


def _leading(frequent, seed: int, longest: int):
    """Counts of leading pairs, and of longer beginnings that are frequent among the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        deep: tuple[list, list] = ([], [])
        held = 0

        def rows(final: bool):
            nonlocal pairs, held
            p, where = np.unique(np.concatenate(pairs[0]), return_inverse=True)
            c = np.bincount(where, np.concatenate(pairs[1]), len(p)).astype(np.int64)
            pairs, held = ([p], [c]), len(p)
            if final or held > FLUSH_PAIRS:
                out = [p, *deep[0]], [c, *deep[1]]
                pairs, held = ([p[:0]], [c[:0]]), 0
                deep[0].clear(), deep[1].clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(out[0]))), pa.array(np.concatenate(out[1]))], schema=_HEADS)

        for words, _ in _read(batches, seed):
            w = _pointers(words, _linked(words, frequent.value), longest)
            for depth in range(2, longest):
                h, c = np.unique(_heads(w, depth), return_counts=True)
                if depth == 2:
                    pairs[0].append(h), pairs[1].append(c)
                    held += len(h)
                else:
                    many = c * HOT_PARTS > len(w)
                    deep[0].append(h[many]), deep[1].append(c[many])
            if held > 2 * FLUSH_PAIRS:
                yield from rows(False)
        yield from rows(True)

    return run


# --- routing and quicksort ----------------------------------------------------------------------------

_ROUTED = pa.schema([("bucket", pa.int32()), ("depth", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_PHRASES = pa.schema([("phrase", pa.list_(pa.int64())), ("a", pa.int64())])


def _routed(frequent, heads, hot, seed: int, buckets: int, longest: int):
    """Equal pointers of a task are one, with a count; they go by their leading words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        over = np.sort(hot.value)

        def rows():
            w = np.concatenate(parts)
            _, first, c = np.unique(_heads(w, longest), return_index=True, return_counts=True)
            w = w[first]
            depth, route = np.full(len(w), 2), _heads(w, 2)
            for d in range(2, longest):  # while the beginning is too frequent, one word more
                more = (depth == d) & np.isin(route, over)
                depth[more] = d + 1
                route[more] = _heads(w[more], d + 1)
            bucket = (route % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((depth, bucket))
            w, c, at = w[order], c[order].astype(np.int64), (bucket * 8 + depth)[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            ids = at[cuts[:-1]]
            return pa.RecordBatch.from_arrays([
                pa.array(ids // 8, pa.int32()), pa.array(ids % 8, pa.int32()),
                pa.array([w[i:j].tobytes() for i, j in spans], pa.binary()),
                pa.array([c[i:j].tobytes() for i, j in spans], pa.binary())], schema=_ROUTED)

        for words, _ in _read(batches, seed):
            linked = _linked(words, frequent.value)
            at = np.flatnonzero(linked)
            pair = np.stack([words.hash[at], words.hash[at + 1]], 1)
            linked[at] = _has(heads.value, _heads(pair, 2))
            if linked.any():
                parts.append(_pointers(words, linked, longest))
                held += len(parts[-1])
            if held > FLUSH_ROWS:
                yield rows()
                parts, held = [], 0
        if held:
            yield rows()

    return run


def quicksort(words: np.ndarray, counts: np.ndarray, least: int, complete: int = 2) -> list[tuple[int, int, int]]:
    """Phrases (row of a pointer, number of words, count) by three-way quicksort of the rows.

    Phrases of two words or more that occur ``least`` times; those of fewer than ``complete`` words
    are parts of a count, since other tasks hold more of them, and come whatever their count.
    """
    found = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth + 1 >= complete and counts[rows].sum() < least:
            continue  # given up: no partition of it can be large enough
        column = words[rows, depth]
        pivot = column[len(column) // 2]
        less, equal = column < pivot, column == pivot
        for side in (rows[less], rows[~less & ~equal]):
            if len(side):
                todo.append((side, depth))
        same = rows[equal]
        size = int(counts[same].sum())
        if pivot == 0 or (size < least and depth + 1 >= complete):
            continue
        if depth:
            found.append((int(same[0]), depth + 1, size))
        if depth + 1 < words.shape[1]:
            todo.append((same, depth + 1))
    return found


def _mined(least: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, counts = None, [], []

        def rows():
            w = np.frombuffer(b"".join(words), np.uint64).reshape(-1, longest)
            found = quicksort(w, np.frombuffer(b"".join(counts), np.int64), least, here[1])
            return pa.RecordBatch.from_arrays([
                pa.array([_signed(w[i, :d]) for i, d, _ in found], pa.list_(pa.int64())),
                pa.array([c for _, _, c in found], pa.int64())], schema=_PHRASES)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, key in enumerate(keys):
                if key != here:
                    if words:
                        yield rows()
                    here, words, counts = key, [], []
                words.append(batch.column(2)[i].as_py())
                counts.append(batch.column(3)[i].as_py())
        if words:
            yield rows()

    return run


# --- operator -------------------------------------------------------------------------------------


def _word_counts(docs: DataFrame, first_seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Staged rows (h, lang, word, c), a word several times, their sums (h, c), and the seed."""
    seed = first_seed
    while True:
        words = staged(docs.mapInArrow(_counted(seed), "h long, lang string, word string, c long"), "words")
        check = F.xxhash64("lang", "word")
        sums = staged(words.select("h", "c", check.alias("x")).groupBy("h").agg(
            F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")), "word-counts")
        if sums.where("low <> high").isEmpty():
            return words, sums.select("h", "c"), seed
        seed += 1


def phrase_counts(docs: DataFrame, least: int, longest: int, words: DataFrame, seed: int) -> DataFrame:
    """Rows (phrase: hashes, a) of all phrases of two words or more that occur ``least`` times."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    frequent = share(table_bits(words.where(F.col("c") >= least), "h", BITS))
    heads = staged(docs.mapInArrow(_leading(frequent, seed, longest), "p long, c long").groupBy("p").agg(
        F.sum("c").alias("c")).where(F.col("c") >= least), "heads")
    total = heads.agg(F.sum("c")).first()[0] or 0
    over = max(HOT_ROWS, total // HOT_PARTS)  # so there are at most some thousands
    hot = np.array([r.p for r in heads.where(F.col("c") > over).select("p").collect()], np.int64).view(np.uint64)
    buckets = max(64, -(-total // BUCKET_ROWS))
    routed = docs.mapInArrow(
        _routed(frequent, share(table_bits(heads, "p", BITS)), share(hot), seed, buckets, longest),
        "bucket int, depth int, words binary, counts binary")
    mined = routed.repartition("bucket").sortWithinPartitions("bucket", "depth").mapInArrow(
        _mined(least, longest), "phrase array<long>, a long")
    return mined.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): every language's ``top`` phrases.

    Pieces of the text end at . , ; : ! ? and line ends, words are parted by blanks, A-Z is
    lower-cased. A phrase of 2 to ``longest`` words that occurs a >= ``least`` times has the lowest
    score floor(1000 * a * n / (l * r)) of its cuts in two, the earliest cut in a tie; a phrase that
    stands only inside a longer one is left out. Order: score and a descending, phrase ascending by
    bytes. Null texts are empty, null languages ``und``; repeated rows count each; no words, or an
    empty table, give no rows; other columns are not read. One piece is held whole.
    """
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNDETERMINED)).alias("lang"), F.col(text).alias("text")
                       ).where("text is not null")
    words, sums, seed = _word_counts(docs)
    common = staged(sums.where(F.col("c") >= least), "frequent-words")
    counted = staged(phrase_counts(docs, least, longest, common, seed), "phrases")

    # a phrase inside a longer one of the same count is inside one that has a single word more
    size = F.size("phrase")
    inner = F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1)))
    longer = counted.where(size > 2).select(inner.alias("phrase"), F.col("a").alias("top")).groupBy(
        "phrase").agg(F.max("top").alias("top"))
    kept = counted.join(longer, "phrase", "left").where("top is null or top < a").select("phrase", "a")

    each = kept.select("phrase", "a", F.posexplode("phrase").alias("pos", "h"))
    names = words.join(each.select("h").distinct(), "h", "left_semi").select("h", "lang", "word").distinct()
    spelled = each.join(names, "h").groupBy("phrase", "a", "lang").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")
    ).select("phrase", "a", "lang", F.array_join("w.word", " ").alias("spelled"))
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    spelled = staged(spelled.join(totals, "lang"), "spelled")

    known = common.select(F.array("h").alias("phrase"), "c").union(counted)
    cuts = spelled.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"lp": F.slice("phrase", F.lit(1), F.col("k")),
                             "rp": F.slice("phrase", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(known.select(F.col("phrase").alias("lp"), F.col("c").alias("l")), "lp").join(
        known.select(F.col("phrase").alias("rp"), F.col("c").alias("r")), "rp")
    wide = "cast({} as decimal(18, 0))"
    score = F.expr(f"(1000 * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "spelled", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", F.col("spelled").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return first_per_group(best, ["lang"], order, top, ["phrase"], rank_col="rank").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same over ``documents`` in DuckDB."""
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, '{UNDETERMINED}') AS lang,
             unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    lengths AS (SELECT lang, w, unnest(range(1, {longest + 1})) AS d FROM listed),
    placed AS (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM lengths WHERE len(w) >= d),
    counts AS (
      SELECT lang, array_to_string(w[i : i + d - 1], ' ') AS phrase, d, count(*) AS c FROM placed
      GROUP BY ALL
    ), totals AS (SELECT lang, sum(c)::BIGINT AS n FROM counts WHERE d = 1 GROUP BY lang),
    known AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE c >= {least}),
    longer AS (
      SELECT lang, array_to_string(w[1 : d - 1], ' ') AS phrase, c FROM known WHERE d > 2
      UNION ALL SELECT lang, array_to_string(w[2 : d], ' '), c FROM known WHERE d > 2
    ), kept AS (
      SELECT * FROM known WHERE d > 1 AND NOT EXISTS (
        SELECT 1 FROM longer WHERE longer.lang = known.lang AND longer.phrase = known.phrase AND longer.c >= known.c)
    ), cuts AS (SELECT *, unnest(range(1, d)) AS k FROM kept),
    scored AS (
      SELECT cuts.lang, cuts.phrase, cuts.c AS a, x.c AS l, y.c AS r, n, k,
             ((1000::HUGEINT * cuts.c * n) // (x.c::HUGEINT * y.c))::BIGINT AS score
      FROM cuts JOIN totals USING (lang)
      JOIN known x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1 : k], ' ')
      JOIN known y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1 : cuts.d], ' ')
    ), lowest AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}
    """
