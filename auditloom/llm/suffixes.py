"""Suffix-array dedup: removes every byte inside a long string that also starts elsewhere.

Windows of ``size`` bytes are equal only if their smallest gram hash stands at the same place, so
every window is filed under that gram (its anchor). Neighbouring windows with one anchor make a
region. Anchors that occur once are done; so are regions with an identical twin. What is left,
where repeats begin, end or differ, goes in shards of bounded size to suffix arrays: ranks
are refined by doubling as Larsson and Sadakane do, common prefixes follow Kasai's rule, and
windows that share ``size`` bytes with a neighbour are repeats. An anchor with very many
regions is dealt over several shards; their sorted window prints are then merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import key_filter, mix, powers, rolling, slices, staged, utf8, with_keys

MOST_GRAM = 64
PLACE_BITS = 24
PIECE_BYTES = 4_000_000  # longer texts are read in overlapping pieces
SHARD_BYTES = 1_000_000
HOT_REGIONS = 1_000  # different regions of one anchor beyond which it is dealt over shards
HOT_COPIES, SALTS = 10_000, 64  # copies of one region beyond which they are dealt over salts
READ_ROWS = 500  # texts taken from a batch together
SEPARATOR = b"\xff"  # no UTF-8 text holds it

_SECOND = np.frombuffer(hashlib.shake_256(b"second print").digest(256 * 8), np.uint64)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            yield batch.slice(at, READ_ROWS)


# --- anchors --------------------------------------------------------------------------------------


def gram_of(size: int) -> int:
    """Bytes of a gram. A text has about 2 / (size - gram) anchors a byte, each a row in every table
    on the way, so short windows get short grams; a gram must still tell most places apart."""
    return max(1, min(MOST_GRAM, size * 2 // 5))


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by running minima from both ends of blocks."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def regions(texts: list[bytes], size: int) -> Iterator[tuple[list, ...]]:
    """Columns (text number, anchor, region print, first window, windows) of slices of texts."""
    pieces, owners = [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - size + 1), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + size - 1]
            if len(piece) >= size:
                pieces.append(piece)
                owners.append((i, at))
    low, gram = np.uint64((1 << PLACE_BITS) - 1), gram_of(size)
    for a, b in slices(pieces):
        part = pieces[a:b]
        joined = b"".join(part)
        s, (_, down) = rolling(np.frombuffer(joined, np.uint8)), powers(len(joined) + 1)
        grams = mix((s[gram:] - s[:-gram]) * down[: len(joined) - gram + 1])
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (_window_least(keys, size - gram + 1) & low).astype(np.int64)
        begin = np.cumsum([0] + [len(p) for p in part])
        inside = np.ones(len(place), bool)
        for edge in begin[1:-1].tolist():
            inside[max(0, edge - size + 1) : edge] = False
        new = inside.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
        first, end = np.flatnonzero(new), np.flatnonzero(last)
        owner = np.searchsorted(begin, first, side="right") - 1
        prints = [
            int.from_bytes(hashlib.blake2b(joined[i : j + size], digest_size=8).digest(), "big", signed=True)
            for i, j in zip(first.tolist(), end.tolist())
        ]
        text_no = [owners[a + o][0] for o in owner.tolist()]
        offset = np.array([owners[a + o][1] for o in owner.tolist()], np.int64) - begin[owner]
        yield (text_no, grams[place[first]].view(np.int64), prints, first + offset, end - first + 1)


_FOUND = pa.schema([("tk", pa.int64()), ("anchor", pa.int64()), ("region", pa.int64()),
                    ("first", pa.int32()), ("windows", pa.int32())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _find(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            tk = batch.column(0).to_numpy()
            for text_no, anchor, prints, first, windows in regions(utf8(batch.column(1)), size):
                yield _batch(_FOUND, tk[text_no], anchor, prints, first.astype(np.int32),
                             windows.astype(np.int32))

    return run


# --- suffix arrays --------------------------------------------------------------------------------


def _words(data: np.ndarray, beyond: int) -> np.ndarray:
    """Eight bytes from every position on as one number, zeros behind the end."""
    padded = np.zeros(len(data) + beyond + 8, np.uint64)
    padded[: len(data)] = data
    out = np.zeros(len(data) + beyond, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(out)]
    return out


def suffix_array(data: np.ndarray, words: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, or of their first ``enough`` bytes; the end
    sorts before every byte.

    Starts from eight bytes and doubles the depth; only groups that still hold several suffixes
    are sorted again, by the rank of what follows.
    """
    n = len(data)
    order = np.argsort(words[:n])
    sorted_ = words[order]
    head = np.r_[True, sorted_[1:] != sorted_[:-1]]
    # suffixes shorter than eight bytes equal others padded with zeros until depth parts them
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while True:
        first = rank[order] == np.arange(n)
        alone = first & np.r_[first[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots) or depth >= (enough or 2 * n + 1):
            return order
        held = order[slots]
        key = rank[held] * (n + 2) + rank[np.minimum(held + depth, n)] + 1
        by = np.argsort(key)
        key = key[by]
        order[slots] = held[by]
        head = np.r_[True, key[1:] != key[:-1]]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        depth *= 2


def common_prefixes(words: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray,
                    size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (positions, common prefix with the suffix sorted before, up to ``size``).

    Kasai's rule: one position on, the prefix is at most one shorter. All regions take their
    steps together, each keeping its own length.
    """
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    length = np.zeros(len(starts), np.int64)
    ends = [1 << (64 - 8 * k) for k in range(1, 8)]
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -step, side="left"))
        at, length = starts[:live] + step, np.maximum(length[:live] - 1, 0)
        other = before[at]
        go = np.flatnonzero(other >= 0)
        length[other < 0] = 0
        while len(go):
            x = words[at[go] + length[go]] ^ words[other[go] + length[go]]
            same = x == 0
            more = np.full(len(go), 8, np.int64)
            if not same.all():
                y = x[~same]
                more[~same] = sum((y < np.uint64(e)).astype(np.int64) for e in ends)
            length[go] = np.minimum(length[go] + more, size)
            go = go[same & (length[go] < size)]
        yield at, length


_SHARD = pa.schema([("shard", pa.int32()), ("hot", pa.bool_()), ("anchor", pa.int64()), ("tk", pa.int64()),
                    ("first", pa.int32()), ("windows", pa.int32()), ("single", pa.bool_()),
                    ("body", pa.binary())])
_MARKS = pa.schema([("tk", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("anchor", pa.int64()),
                    ("range", pa.int32()), ("prints", pa.binary()), ("owners", pa.binary())])


def _cut(size: int):
    """Cuts the regions out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out: tuple[list, ...] = tuple([] for _ in _SHARD)
            for tk, text, cuts in zip(batch.column(0).to_pylist(), utf8(batch.column(1)),
                                      batch.column(2).to_pylist()):
                for c in cuts:
                    body = text[c["first"] : c["first"] + c["windows"] + size - 1]
                    for column, value in zip(out, (c["shard"], c["hot"], c["anchor"], tk, c["first"],
                                                   c["windows"], c["single"], body)):
                        column.append(value)
            yield _batch(_SHARD, *out)

    return run


def repeats(bodies: list[bytes], counts: np.ndarray, size: int):
    """For regions with ``counts`` windows each: the joined bytes, their starts, and for every
    window position whether it repeats in the shard and whether it stands for others there."""
    data = np.frombuffer(SEPARATOR.join(bodies) + SEPARATOR, np.uint8)
    starts = np.cumsum([0] + [len(b) + 1 for b in bodies[:-1]])
    words = _words(data, size + 8)
    order = suffix_array(data, words)
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    as_before = np.zeros(len(data), bool)
    for at, length in common_prefixes(words, before, starts, counts, size):
        as_before[at] = length >= size
    repeated = as_before.copy()
    repeated[before[as_before]] = True
    return data, starts, repeated, repeated & ~as_before


def _sort_shards(size: int, bits: int):
    """Marks of the windows of single regions that repeat; prints of windows of hot anchors, in
    2^bits ranges."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.array([r[5] for r in rows], np.int64)
        data, starts, repeated, stands = repeats([r[7] for r in rows], counts, size)
        tk, a, b = [], [], []
        for row, s, n in zip(rows, starts.tolist(), counts.tolist()):
            if row[6]:
                turn = np.diff(np.r_[0, repeated[s : s + n].astype(np.int8), 0])
                for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
                    tk.append(row[3]), a.append(row[4] + i), b.append(row[4] + j - 1)
        none = [None] * len(tk)
        yield _batch(_MARKS, tk, a, b, none, none, none, none)
        hot = [i for i, r in enumerate(rows) if r[1]]
        if not hot:
            return
        # one print for each different window here; alone and of a single region: marked if met
        _, down = powers(len(data) + 1)
        one = rolling(data)
        two = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SECOND[data] * powers(len(data) + 1)[0][: len(data)], out=two[1:])
        for anchor in {rows[i][2] for i in hot}:
            mine = [i for i in hot if rows[i][2] == anchor]
            at = np.concatenate([starts[i] + np.arange(counts[i]) for i in mine])
            owner = np.repeat(mine, counts[mine])
            shown = ~repeated[at] | stands[at]
            at, owner = at[shown], owner[shown]
            prints = np.stack([mix((s[at + size] - s[at]) * down[at]) for s in (one, two)], 1)
            asks = ~repeated[at] & np.array([rows[i][6] for i in owner.tolist()], bool)
            back = np.stack([
                np.array([rows[i][3] for i in owner.tolist()], np.int64),
                np.where(asks, np.array([rows[i][4] for i in owner.tolist()], np.int64) + at - starts[owner], -1),
            ], 1)
            part = (prints[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
            for k in np.unique(part).tolist():
                held = np.flatnonzero(part == k)
                held = held[np.lexsort((prints[held, 1], prints[held, 0]))]
                yield _batch(_MARKS, [None], [None], [None], [anchor], [k],
                             [prints[held].tobytes()], [back[held].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, held = None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != here:
                    if rows:
                        yield from solve(rows)
                    here, rows, held = row[0], [], 0
                rows.append(row)
                held += len(row[7])
        if rows:
            yield from solve(rows)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looks the sorted prints of every shard up in those of the shards before and after it."""

    def solve(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = [np.ascontiguousarray(p.astype(">u8")).view("V16").ravel() for p, _ in held]
        merged, times = np.unique(np.concatenate(names), return_counts=True)
        for name, (_, back) in zip(names, held):
            found = times[np.searchsorted(merged, name)] > 1
            hit = back[found & (back[:, 1] >= 0)]
            none = [None] * len(hit)
            yield _batch(_MARKS, hit[:, 0], hit[:, 1].astype(np.int32), hit[:, 1].astype(np.int32),
                         none, none, none, none)

    here, held = None, []
    for batch in batches:
        for anchor, part, prints, owners in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (anchor, part) != here:
                if held:
                    yield from solve(held)
                here, held = (anchor, part), []
            held.append((np.frombuffer(prints, np.uint64).reshape(-1, 2),
                         np.frombuffer(owners, np.int64).reshape(-1, 2)))
    if held:
        yield from solve(held)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "bool": "boolean"}
    return ", ".join(f"`{f.name}` {kinds.get(str(f.type), str(f.type))}" for f in schema)


# --- the operator ---------------------------------------------------------------------------------


def repeated_starts(docs: DataFrame, size: int) -> DataFrame:
    """Rows (tk, a, b) of texts (tk, text): windows starting at a to b occur elsewhere too."""
    spark = docs.sparkSession
    found = staged(docs.where(F.octet_length("text") >= size).mapInArrow(_find(size), _ddl(_FOUND)), "regions")
    anchors = staged(
        found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("region").alias("x"), F.max("region").alias("y"))
        .where("c > 1").select("anchor", (F.col("x") != F.col("y")).alias("several")),
        "anchors",
    )
    again = staged(found.join(anchors, "anchor"), "repeated")
    classes = staged(
        again.groupBy("anchor", "region", "windows", "several").agg(
            F.count("*").alias("c"), F.first("tk").alias("tk"), F.first("first").alias("first")),
        "classes",
    )
    # the copies of a very frequent region are dealt over salts; at most a thousand are so frequent
    most = max(HOT_COPIES, (classes.agg(F.sum("c")).first()[0] or 0) // 1000)
    often = [r.region for r in classes.where(F.col("c") > most).select("region").distinct().collect()]
    is_often = F.col("region").isin(often) if often else F.lit(False)
    salt = F.when(is_often, F.pmod(F.xxhash64("tk", "first"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(is_often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    twins = again.withColumn("salt", salt).join(
        classes.where("c > 1").select("anchor", "region", "windows", F.explode(salts).alias("salt")),
        ["anchor", "region", "windows", "salt"],
    ).select("tk", F.col("first").alias("a"), (F.col("first") + F.col("windows") - 1).alias("b"))

    open_ = classes.where("several")
    held = open_.agg(F.count("*").alias("n"), F.sum(F.col("windows") + size).alias("bytes")).first()
    if not held.n:
        return twins.distinct()
    parts = staged(
        open_.groupBy("anchor").agg(F.ceil(F.count("*") / HOT_REGIONS).cast("int").alias("parts"))
        .where("parts > 1"), "hot-anchors")
    hot = not parts.isEmpty()
    shards = -(-held.bytes // (SHARD_BYTES // 2)) + 1
    bits = max(6, int(shards).bit_length())  # an anchor may hold most regions: as many ranges as shards
    open_ = open_.join(parts, "anchor", "left")
    hot_parts = F.col("parts")
    spread = F.xxhash64("anchor", F.coalesce(F.pmod(F.col("region"), hot_parts), F.lit(-1)))
    cuts = open_.select(
        "tk",
        F.struct(
            F.pmod(spread, F.lit(shards)).cast("int").alias("shard"), hot_parts.isNotNull().alias("hot"),
            "anchor", "first", "windows", (F.col("c") == 1).alias("single"),
        ).alias("cut"),
    ).groupBy("tk").agg(F.collect_list("cut").alias("cuts"))  # at most one for each byte of a text
    cuts = staged(cuts, "cuts")
    texts = with_keys(docs.select("tk", "text"), "tk", cuts).groupBy("tk").agg(F.first("text").alias("text"))
    marks = staged(
        texts.join(cuts, "tk").select("tk", "text", "cuts").mapInArrow(_cut(size), _ddl(_SHARD))
        .repartition("shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(size, bits), _ddl(_MARKS)),
        "marks",
    )
    out = twins.union(marks.where("tk is not null").select("tk", "a", "b"))
    if hot:
        met = (
            marks.where("tk is null").select("anchor", "range", "prints", "owners")
            .repartition("anchor", "range").sortWithinPartitions("anchor", "range")
            .mapInArrow(_merge, _ddl(_MARKS))
        )
        out = out.union(met.select("tk", "a", "b"))
    return out.distinct()


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words that lie in a range of a text, without those its ends cut in two."""
    n = len(text[start:end].split())
    for at in (start, end):
        if n and 0 < at < len(text) and not text[at - 1 : at].isspace() and not text[at : at + 1].isspace():
            n -= 1
    return n


def _remove(size: int, columns: int, words: int, enough: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts, starts = utf8(batch.column(columns)), batch.column(columns + 1).to_pylist()
            kept, spans = [], []
            for text, marks in zip(texts, starts):
                passages: list[list[int]] = []  # first and last of successive windows
                for m in sorted((m["a"], m["b"]) for m in marks):
                    if passages and m[0] <= passages[-1][1] + 1:
                        passages[-1][1] = max(passages[-1][1], m[1])
                    else:
                        passages.append([*m])
                runs: list[list[int]] = []
                for a, b in passages:
                    end = b + size
                    if end - a < enough and whole_words(text, a, end) < words:
                        continue
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([a, end])
                at, left = 0, []
                for i, j in runs:
                    left.append(text[at:i])
                    at = j
                left.append(text[at:])
                kept.append(b"".join(left))
                spans.append([{"start": i, "end": j} for i, j in runs])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*batch.schema.names[:columns], "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, size: int = 400, text: str = "text", words: int = 0,
                   enough: int = 0) -> DataFrame:
    """Adds ``kept`` (binary: the remaining bytes) and ``spans`` (removed byte ranges, merged).

    A byte goes if a string of ``size`` bytes around it starts anywhere else as well, in the same
    text or another; the first occurrence goes too. Null and empty texts and texts shorter
    than ``size`` lose nothing; equal rows of that length lose everything. With ``words``, successive
    repeats go only if they hold so many whole words or ``enough`` bytes. Input columns of the
    two names are replaced; others pass through, the text as it was.
    """
    columns = [c for c in docs.columns if c not in ("kept", "spans")]
    keyed = docs.select(*columns, F.xxhash64(text).alias("_tk"), F.col(text).alias("_text"))
    starts = staged(
        repeated_starts(docs.select(F.xxhash64(text).alias("tk"), F.col(text).alias("text")), size)
        .groupBy("tk").agg(F.collect_list(F.struct("a", "b")).alias("_marks")),
        "starts",
    )
    maybe = key_filter(starts, "tk")(F.col("_tk"))
    whole = [F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("kept"),
             F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans")]
    clear = keyed.where(~maybe).select(*columns, *whole)
    touched = keyed.where(maybe).join(starts.withColumnRenamed("tk", "_tk"), "_tk", "left").select(
        *columns, "_text", F.coalesce("_marks", F.expr("cast(array() as array<struct<a: int, b: int>>)")).alias("_marks"))
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*columns).dtypes)
    removed = touched.mapInArrow(
        _remove(size, len(columns), words, enough), f"{fields}, kept binary, spans array<struct<start: bigint, end: bigint>>")
    return clear.union(removed)
