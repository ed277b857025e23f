"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; equal sets are one class. Classes that share their smallest
shingle hash meet in one place, where each joins the first leader it is similar to: a leader and
its followers are a group. Every group's union of prefix shingles becomes rows of a matrix
(shingle, group), dealt by shingle. Two groups that share too few of them, or whose leaders are
too far apart, cannot hold a similar pair; only the others are opened and compared exactly.
A shingle counts only for sizes it can matter at: the later it stands in a prefix, the smaller
the similar sets that may be met there first. So edits of one text that are too far from each
other do not meet in what is left of it.

Prefixes follow one global order, rare shingles first by a count sketch of fixed size, so that
passages common to many documents do not make their groups meet. The order decides only how
much work there is: any order gives the same links.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import components, key_filter, mix, powers, rolling, slices
from auditloom.llm.common import staged, utf8

SKETCH_BITS, SKETCH_PARTS = 22, 64
LEADERS = 8  # leaders of one meeting place that followers are compared with
PLACE_ROWS = 20_000  # a fuller meeting place is dealt over several, see _places
BUCKET_TOKENS = 300_000
BLOCK_TOKENS = 100_000  # shingles of a block of members when groups are opened, about
READ_ROWS = 500  # texts taken from a batch together
FLUSH_TOKENS = 500_000
SIZE_STEPS = 3_000  # sizes are kept as 16-bit logarithms, in so many steps for each factor of e
SUMMED = 64  # groups of tasks whose counts are added before all are

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = [np.uint64(int.from_bytes(hashlib.md5(b"%d" % i).digest()[:8], "big") | 1) for i in range(64)]


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each text; words lower-cased for A-Z alone."""
    for a, b in slices(texts):
        part = texts[a:b]
        data = _LOWER[np.frombuffer(b"\n" + b"\n".join(part) + b"\n", np.uint8)]
        word = (~_SPACE[data]).astype(np.int8)
        turn = np.diff(word)
        starts, ends = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
        s, (_, down) = rolling(data), powers(len(data) + 1)
        words = mix((s[ends] - s[starts]) * down[starts])
        joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            joined += words[j : j + len(joined)] * _ODD[j]
        joined = mix(joined)
        first = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in part]))
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= width:
                yield np.unique(joined[lo : hi - width + 1])
            elif hi > lo:
                few = np.append(words[lo:hi] * np.array(_ODD[: hi - lo]), _ODD[width + hi - lo])
                yield mix(few.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def class_of(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "big", signed=True)


def place_of(u: np.ndarray) -> int:
    return int(mix(u * _ODD[60]).min().astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether 100 * intersection >= percent * union, and the similarity."""
    if not len(a) or not len(b):
        return False, 0.0
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) // 4:
        return False, 0.0
    common = overlap(a, b)
    union = len(a) + len(b) - common
    return 100 * common >= percent * union, common / union


def slack(n, percent: int):
    """Shingles of a set that a similar set may lack."""
    return n - -(-n * percent // 100)


def shared_least(n):
    """Prefixes are longer than needed by this less one; similar sets share so many in them."""
    return np.maximum(1, n // 20)


def most_partner(n: int, percent: int) -> np.ndarray:
    """For each place of a prefix, the size of the largest set it can matter to.

    Of sets of n and m shingles that share enough to be similar, the first n - shared + k and the
    first m - shared + k hold k in common, at ``shared_least`` k for the smaller.
    """
    k = int(shared_least(n))
    left = n + k - 1 - np.arange(slack(n, percent) + k)
    return np.maximum(1, (100 + percent) * left // percent - n)


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at a time that their texts take little memory twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            yield batch.slice(at, READ_ROWS)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- first pass: classes and the sketch ----------------------------------------------------------

_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
                    ("place", pa.int64()), ("tk", pa.int64()), ("part", pa.int32()),
                    ("counts", pa.binary())])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in few(batches):
        texts = utf8(batch.column(2))
        n, cls, place, tokens = [], [], [], []

        def add():
            if tokens:
                at = (np.concatenate(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                sketch[:] += np.bincount(at, minlength=len(sketch)).astype(np.uint32)
                tokens.clear()

        held = 0
        for u in shingle_sets(texts):
            n.append(len(u))
            cls.append(class_of(u) if len(u) else None)
            place.append(place_of(u) if len(u) else None)
            tokens.append(u)
            held += len(u)
            if held > FLUSH_TOKENS:
                add()
                held = 0
        add()
        none = [None] * len(n)
        yield _rows(_FIRST, batch.column(0), n, cls, place, batch.column(1), none, none)
    if sketch.any():
        none = [None] * SKETCH_PARTS
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SKETCH_PARTS)]
        yield _rows(_FIRST, none, none, none, none, none, range(SKETCH_PARTS), parts)


def _add_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in pdf["counts"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _rank_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
    rank = np.minimum(255, np.round(8 * np.log2(np.maximum(1, total)))).astype(np.uint8)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "ranks": [rank.tobytes()]})


# --- second pass: groups and the matrix ------------------------------------------------------------

_PLACED = pa.schema([("place", pa.int64()), ("salt", pa.int32()), ("rare", pa.int32()),
                     ("cls", pa.int64()), ("text", pa.string())])
_MATRIX = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.int64()),
                     ("b", pa.int64()), ("n", pa.int64()), ("far", pa.float64()),
                     ("tokens", pa.binary()), ("groups", pa.binary()), ("most", pa.binary()),
                     ("low", pa.binary())])
_PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
                    ("far", pa.float64())])


def _placed(salts: dict[int, int], ranks):
    """Where a class is grouped, and how rare its shingles are: what is most common leads, as the
    text that others are edits of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in few(batches):
            texts, turns = utf8(batch.column(1)), batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, u in enumerate(shingle_sets(texts)):
                if not len(u) or (cls := class_of(u)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cls)
                place = place_of(u)
                common = ranks.value[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].mean()
                row = (place, turns[i] % salts.get(place, 1), int(-1000 * common), cls, i)
                for column, value in zip(out, row):
                    column.append(value)
            kept = batch.column(1).take(pa.array(out[4], pa.int64()))
            yield _rows(_PLACED, *out[:4], kept)

    return run


class _Leader:
    """A leader and the prefix shingles of its group, with the largest set each can matter to."""

    def __init__(self, cls: int, u: np.ndarray, prefix: np.ndarray, most: np.ndarray):
        self.cls, self.u, self.low = cls, u, len(u)
        self.union, self.most = prefix, most

    def add(self, n: int, prefix: np.ndarray, most: np.ndarray) -> None:
        self.low = min(self.low, n)
        at = np.searchsorted(self.union, prefix)
        known = np.flatnonzero(at < len(self.union))
        known = known[self.union[at[known]] == prefix[known]]
        self.most[at[known]] = np.maximum(self.most[at[known]], most[known])
        new = np.ones(len(prefix), bool)
        new[known] = False
        self.union = np.insert(self.union, at[new], prefix[new])
        self.most = np.insert(self.most, at[new], most[new])


def _grouped(ranks, bucket_bits: int, percent: int):
    """Rows of a partition in order of place, salt, rarity and class: groups, and tokens by bucket."""

    def prefix_of(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = most_partner(len(u), percent)
        rank = ranks.value[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        first = np.argsort(rank, kind="stable")[: len(most)]  # u is sorted: ties by hash
        most = np.ceil(SIZE_STEPS * np.log(most[: len(first)])).astype(np.uint16)
        order = np.argsort(first)
        return u[first[order]], most[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, leaders, last = None, [], None
        tokens, mosts, groups, held = [], [], [], 0

        def emit(x: _Leader) -> int:
            tokens.append(x.union), mosts.append(x.most)
            low = int(SIZE_STEPS * np.log(x.low))
            groups.append((x.cls, low, len(x.union)))
            return len(x.union)

        def flush():
            t, m = np.concatenate(tokens), np.concatenate(mosts)
            sizes = [k for _, _, k in groups]
            g = np.repeat(np.array([c for c, _, _ in groups], np.int64), sizes)
            low = np.repeat(np.array([x for _, x, _ in groups], np.uint16), sizes)
            order = np.argsort(t, kind="stable")
            t, g, m, low = t[order], g[order], m[order], low[order]
            tokens.clear(), mosts.clear(), groups.clear()
            bucket = (t >> np.uint64(64 - bucket_bits)).astype(np.int64)
            short = ((t >> np.uint64(32 - bucket_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(t)]
            ids = bucket[cuts[:-1]].tolist()
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            none = [None] * len(ids)
            return _rows(_MATRIX, [1] * len(ids), ids, none, none, none, none,
                         [short[i:j].tobytes() for i, j in spans],
                         [g[i:j].tobytes() for i, j in spans],
                         [m[i:j].tobytes() for i, j in spans],
                         [low[i:j].tobytes() for i, j in spans])

        for batch in few(batches):
            places, salts, classes = (batch.column(i).to_pylist() for i in (0, 1, 3))
            members: tuple[list, ...] = ([], [], [], [])
            for i, u in enumerate(shingle_sets(utf8(batch.column(4)))):
                if (places[i], salts[i]) != here:
                    held += sum(map(emit, leaders))
                    here, leaders, last = (places[i], salts[i]), [], None
                if classes[i] == last:
                    continue
                last = classes[i]
                prefix, most = prefix_of(u)
                leader, near = None, 1.0
                for x in leaders:
                    link, near = linked(u, x.u, percent)
                    if link:
                        leader = x
                        break
                if leader is None:
                    near = 1.0
                    leader = _Leader(last, u, prefix, most)
                    if len(leaders) < LEADERS:
                        leaders.append(leader)
                    else:  # nothing is compared with it, so it stays alone
                        held += emit(leader)
                else:
                    leader.add(len(u), prefix, most)
                    if len(leader.union) > 1_000_000:
                        held += emit(leader)
                        leader.union, leader.most = prefix[:0], most[:0]
                for column, value in zip(members, (last, leader.cls, len(u), 1 - near)):
                    column.append(value)
                if held > 1_000_000:
                    yield flush()
                    held = 0
            none = [None] * len(members[0])
            spread = [c % (1 << bucket_bits) for c in members[0]]
            yield _rows(_MATRIX, [0] * len(spread), spread, *members, none, none, none, none)
        held += sum(map(emit, leaders))
        if held:
            yield flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups with the number of prefix shingles they share in a bucket, and the fewest
    that similar members share in all buckets. Shingles count where they can matter to both."""

    def paired(columns: list[tuple]) -> Iterator[pa.RecordBatch]:
        t, g, most, low = (np.frombuffer(b"".join(c), kind) for c, kind in zip(
            zip(*columns), (np.uint32, np.int64, np.uint16, np.uint16)))
        order = np.lexsort((g, t))
        t, g, most, low = t[order], g[order], most[order], low[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])])
        t, g = t[new], g[new]
        most, low = np.maximum.reduceat(most, new), np.minimum.reduceat(low, new)
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        held = most >= np.repeat(np.minimum.reduceat(low, first), np.diff(np.r_[first, len(t)]))
        t, g, most, low = t[held], g[held], most[held], low[held]
        twice = np.flatnonzero(t[1:] == t[:-1])
        held = np.union1d(twice, twice + 1)
        t, g, most, low = t[held], g[held], most[held], low[held]
        least = shared_least(np.exp(low / SIZE_STEPS).astype(np.int64))
        found, size, step = [], 0, 1

        def counted():
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            at = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            n = np.diff(np.r_[at, len(rows)])
            return _rows(_PAIRS, [1] * len(n), rows[at, 0], rows[at, 1], n,
                         np.minimum.reduceat(rows[:, 2], at).astype(np.float64))

        at = np.arange(len(t))
        while len(at):
            at = at[at + step < len(t)]
            at = at[t[at] == t[at + step]]
            both = at[(low[at + step] <= most[at]) & (low[at] <= most[at + step])]
            if len(both):
                found.append(np.stack(
                    [g[both], g[both + step], np.minimum(least[both], least[both + step])], 1))
                size += len(both)
            if size > 1_000_000:
                yield counted()
                found, size = [], 0
            step += 1
        if size:
            yield counted()

    here, columns = None, []
    for batch in batches:
        kinds, buckets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        group_rows = [i for i, k in enumerate(kinds) if k == 0]
        if group_rows:
            part = batch.take(pa.array(group_rows, pa.int64()))
            yield _rows(_PAIRS, part.column(0), *part.columns[2:6])
        for i, kind in enumerate(kinds):
            if kind == 0:
                continue
            if buckets[i] != here:
                if columns:
                    yield from paired(columns)
                here, columns = buckets[i], []
            columns.append(tuple(batch.column(c)[i].as_py() for c in (6, 7, 8, 9)))
    if columns:
        yield from paired(columns)


# --- opening --------------------------------------------------------------------------------------

_OPENED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_()), ("j", pa.float64())])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            left, right = (shingle_sets(utf8(batch.column(i))) for i in (2, 3))
            told = [linked(u, v, percent) for u, v in zip(left, right)]
            yield _rows(_OPENED, batch.column(0), batch.column(1), [x for x, _ in told],
                        [j for _, j in told])

    return run


class _Members:
    """Opened members of a group, or of a part of it: sets, and an index of their shingles."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.far: list[float] = []
        self.tokens: np.ndarray | None = None

    def add(self, u: np.ndarray, far: float) -> None:
        self.sets.append(u), self.far.append(far)

    def index(self) -> None:
        if self.tokens is None:
            self.sizes = np.array([len(u) for u in self.sets], np.int64)
            tokens = np.concatenate(self.sets)
            order = np.argsort(tokens, kind="stable")
            self.tokens = tokens[order]
            self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]

    def meets(self, u: np.ndarray, percent: int) -> bool:
        """Whether a member is similar to the set."""
        lo = np.searchsorted(self.tokens, u, "left")
        n = np.searchsorted(self.tokens, u, "right") - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return bool((100 * common >= percent * (self.sizes + len(u) - common)).any())


def _any_link(a: _Members, b: _Members, least_a: float, least_b: float, percent: int) -> bool:
    """Whether members of two groups are linked; those nearer to their leaders than the least
    cannot be."""
    if sum(f >= least_a for f in a.far) > sum(f >= least_b for f in b.far):
        a, b, least_a = b, a, least_b
    b.index()
    return any(b.meets(u, percent) for u, far in zip(a.sets, a.far) if far >= least_a)


def _open(percent: int):
    """Rows of a task: pairs (kind 0) of parts of groups, then members (kind 1) of the parts. Groups
    hang together, so one link is enough, and none is looked for between groups that already do."""
    reach = 1 - percent / 100 + 1e-9

    def judged(pairs: list[tuple], members: dict[tuple, _Members]) -> pa.RecordBatch:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        found: tuple[list, list] = ([], [])
        for d, a, i, b, j, ra, rb in sorted(pairs):
            x, y = root(a), root(b)
            if x == y or (a, i) not in members or (b, j) not in members:
                continue
            if _any_link(members[a, i], members[b, j], d - reach - rb, d - reach - ra, percent):
                top[max(x, y)] = min(x, y)
                found[0].append(a), found[1].append(b)
        return _rows(_OPENED, *found, [True] * len(found[0]), [None] * len(found[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pairs, members = None, [], {}
        for batch in few(batches):
            keys, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(2, 9))))  # d, a, i, b, j, ra, rb
            for key, kind, row, u in zip(keys, kinds, rows, shingle_sets(utf8(batch.column(9)))):
                if key != here:
                    if pairs:
                        yield judged(pairs, members)
                    here, pairs, members = key, [], {}
                if kind == 0:
                    pairs.append(row)
                else:
                    members.setdefault((row[1], row[2]), _Members()).add(u, row[0])
        if pairs:
            yield judged(pairs, members)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "double": "double", "bool": "boolean"}
    return ", ".join(f"{f.name} {kinds.get(str(f.type), str(f.type))}" for f in schema)


def _opened(open_: DataFrame, members: DataFrame, texts_of, percent: int) -> DataFrame:
    """Links (a, b) between the groups of open pairs (a, b, d, ra, rb), enough to join what belongs
    together.

    Groups go by the smallest partner they have, so those of one cluster lie together; all with one
    such label, large ones in parts, are dealt over blocks of members. A task holds two blocks and
    judges their pairs. So a member is sent to as many tasks as its partners fill blocks, however
    many they are.
    """
    reach = 1 - percent / 100 + 1e-9
    need = open_.select(F.explode(F.array(
        F.struct(F.col("a").alias("grp"), (F.col("d") - reach - F.col("rb")).alias("least"), F.least("a", "b").alias("x")),
        F.struct(F.col("b").alias("grp"), (F.col("d") - reach - F.col("ra")).alias("least"), F.least("a", "b").alias("x")),
    )).alias("e")).groupBy("e.grp").agg(F.min("e.least").alias("least"), F.min("e.x").alias("label"))
    asked = staged(members.join(need, "grp").where("far >= least").select(
        "grp", "label", "cls", "far", "n"), "asked")
    groups = asked.groupBy("grp", "label").agg(F.sum("n").alias("n"))
    groups = groups.withColumn("parts", F.ceil(F.col("n") / BLOCK_TOKENS).cast("int"))
    blocks = groups.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    groups = staged(groups.join(blocks, "label").select("grp", "label", "parts", "blocks"), "layout")

    def parts(side: str, part: str) -> DataFrame:
        numbered = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = F.pmod(F.xxhash64("grp", "part"), F.col("blocks")).cast("int")
        return numbered.select(F.col("grp").alias(side), F.col("part").alias(part),
                               F.struct("label", block.alias("block")).alias(f"home_{side}"))

    pairs = staged(
        open_.join(parts("a", "i"), "a").join(parts("b", "j"), "b").select(
            F.least("home_a", "home_b").alias("lo"), F.greatest("home_a", "home_b").alias("hi"),
            "d", "a", "i", "b", "j", "ra", "rb"
        ).select(F.xxhash64("lo", "hi").alias("task"), "d", "a", "i", "b", "j", "ra", "rb"),
        "pairs",
    )
    sent = pairs.select("task", F.explode(F.array(
        F.struct(F.col("a").alias("grp"), F.col("i").alias("part")),
        F.struct(F.col("b").alias("grp"), F.col("j").alias("part")))).alias("x")
    ).select("task", "x.grp", "x.part").distinct()
    of_part = asked.join(groups.select("grp", "parts"), "grp").select(
        "cls", "grp", "far", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    rows = of_part.join(sent, ["grp", "part"]).select(
        "cls", "task", F.lit(1).alias("kind"), F.col("far").alias("d"), F.col("grp").alias("a"),
        F.col("part").alias("i"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("b", "long"), ("j", "int"), ("ra", "double"), ("rb", "double"))))
    told = rows.join(texts_of(asked), "cls").drop("cls").union(
        pairs.select("task", F.lit(0), "d", "a", "i", "b", "j", "ra", "rb", F.lit("")))
    return told.repartition("task").sortWithinPartitions("task", "kind").mapInArrow(
        _open(percent), _ddl(_OPENED)).select("a", "b")


def jaccard_components(docs: DataFrame, percent: int = 75, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one per document.

    ``class_id`` stands for the document's set (equal sets are linked); ``component_id`` is the
    smallest key reachable by links, itself included. Null, empty and blank texts have no
    shingles, a null class and only their own key; repeated rows and ties fall in one class; an
    empty table gives no rows; other columns are not read. ``key`` must be a long and may be null.
    """
    return _components(docs, percent, key, text).drop("tk", "component")


def _components(docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """The same rows with ``tk``, a hash of the text, and ``component``, by class: two may share an id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("tk"))
    first = staged(docs.select("doc_id", "tk", "text").mapInArrow(_describe, _ddl(_FIRST)), "sets")
    sets = first.where("part is null").select("doc_id", "n", "cls", "place", "tk")
    full = sets.where("cls is not null")

    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)  # SKETCH_PARTS rows, 2^SKETCH_BITS bytes in all
    width = len(ranks) // SKETCH_PARTS
    counts = first.where("part is not null").select(
        "part", "counts", F.pmod(F.xxhash64("counts"), F.lit(SUMMED)).alias("some"))
    counts = counts.groupBy("part", "some").applyInPandas(_add_parts, "part int, counts binary")
    for row in counts.groupBy("part").applyInPandas(_rank_parts, "part int, ranks binary").collect():
        ranks[row.part * width : (row.part + 1) * width] = np.frombuffer(row.ranks, np.uint8)
    told = full.agg(F.count("*").alias("rows"), F.sum(F.expr("n * 3 div 10 + 1")).alias("tokens")).first()
    bits = max(6, int(np.ceil(np.log2((told.tokens or 1) / BUCKET_TOKENS + 1))))

    # at most a thousand places are so full, whatever the number of documents
    most = max(PLACE_ROWS, told.rows // 1000)
    salts = {r.place: -(-r.c // most) for r in full.groupBy("place").agg(F.count("*").alias("c"))
             .where(F.col("c") > most).collect()}
    held_ranks = spark.sparkContext.broadcast(ranks)
    placed = docs.where("text is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("turn"), "text"
    ).mapInArrow(_placed(salts, held_ranks), _ddl(_PLACED))
    matrix = (
        placed.repartition("place", "salt").sortWithinPartitions("place", "salt", "rare", "cls")
        .mapInArrow(_grouped(held_ranks, bits, percent), _ddl(_MATRIX))
    )
    met = staged(
        matrix.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _ddl(_PAIRS)),
        "matrix",
    )
    # a class with copies in several salts may lead in one and follow others elsewhere: each counts
    members = staged(
        met.where("kind = 0").groupBy(F.col("a").alias("cls"), F.col("b").alias("grp")).agg(
            F.max("far").alias("far"), F.first("n").alias("n")),
        "members",
    )
    own = staged(
        members.groupBy("cls").agg(F.min("grp").alias("own"), F.max("grp").alias("other")), "own")
    size = members.groupBy("grp").agg(F.count("*").alias("members"), F.max("far").alias("radius"))
    groups = staged(
        members.where("cls = grp").select("grp", "n").join(size, "grp"), "groups")

    # bounds on groups: shared prefix shingles, and sizes within three steps of the threshold
    def described(side: str) -> DataFrame:
        return groups.select(F.col("grp").alias(side), F.col("n").alias(f"n{side}"),
                             F.col("members").alias(f"m{side}"), F.col("radius").alias(f"r{side}"))

    share = percent / 100
    counted = staged(
        met.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("c"), F.min("far").alias("least"))
        .where("c >= least").select("a", "b"),
        "shared",
    )
    bound = staged(
        counted.join(described("a"), "a").join(described("b"), "b")
        .where(F.least("na", "nb") >= F.floor(F.greatest("na", "nb") * share**3))
        .select("a", "b", "ma", "mb", "ra", "rb"),
        "bound",
    )

    of_class = staged(full.groupBy("cls").agg(F.min("tk").alias("tk")), "texts")

    def texts_of(needed: DataFrame) -> DataFrame:
        wanted = staged(needed.select("cls").distinct().join(of_class, "cls"), "wanted")
        maybe = key_filter(wanted, "tk")(F.col("tk"))
        found = docs.select("tk", "text").where(maybe).groupBy("tk").agg(F.first("text").alias("text"))
        return staged(found.join(wanted, "tk").select("cls", "text"), "wanted-texts")

    held = texts_of(bound.select(F.col("a").alias("cls")).union(bound.select("b")))
    leaders = staged(
        bound.select("a", "b").join(held.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        .join(held.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb").mapInArrow(_compare(percent), _ddl(_OPENED)),
        "leaders",
    )
    # the groups of one class in several salted places hang together through it
    same = members.join(own.where("own <> other"), "cls").where("grp <> own").select(
        F.col("own").alias("a"), F.col("grp").alias("b")).distinct()
    links = leaders.where("link").select("a", "b").union(same)
    so_far = staged(components(links), "components")

    def component(side: str) -> DataFrame:
        return so_far.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))

    # distance is a metric: two groups, or two members, that their distances to the leaders keep
    # apart are not compared, nor are groups that hang together already
    reach = 1 - share + 1e-9
    open_ = staged(
        leaders.where("not link").join(bound, ["a", "b"])
        .where((F.col("ma") > 1) | (F.col("mb") > 1))
        .withColumn("d", 1 - F.col("j")).where(F.col("d") <= reach + F.col("ra") + F.col("rb"))
        .join(component("a"), "a", "left").join(component("b"), "b", "left")
        .where("not coalesce(ca, a) <=> coalesce(cb, b)").select("a", "b", "d", "ra", "rb"),
        "open",
    )
    if not open_.isEmpty():
        links = staged(links.union(_opened(open_, members, texts_of, percent)), "links")
        so_far = staged(components(links), "components")

    of_member = own.join(so_far, F.col("own") == F.col("id"), "left").select(
        "cls", F.coalesce("component", "own").alias("component"))
    of_member = staged(of_member, "classes")
    least = staged(full.groupBy("cls").agg(F.min("doc_id").alias("m")), "least")
    least = staged(least.join(of_member, "cls").groupBy("component").agg(F.min("m").alias("component_id")),
                   "least")
    named = staged(of_member.join(least, "component").select("cls", "component", "component_id"), "named")
    return sets.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "tk", "component",
    )


def one_of_each(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are linked to a smaller key, columns as they were.

    Of linked rows that share a key one stays, of equal rows too; rows that share a key and are not
    linked all stay, and so do rows without a key: nothing can name them. Texts without a word are
    linked with nothing. An empty table stays empty. Only rows that may have to go are shuffled
    with their texts.
    """
    found = staged(_components(docs, percent, key, text).where("doc_id is not null"), "found")
    heads = found.where("doc_id = component_id and class_id is not null")
    first = heads.groupBy("doc_id", "component").agg(
        F.min("tk").alias("first"), F.max("tk").alias("last")).where("first < last")
    others = heads.join(first.drop("last"), ["doc_id", "component"]).where("tk <> first").select("doc_id", "tk")
    gone = staged(
        found.where("doc_id <> component_id").select("doc_id", "tk").union(others).distinct(), "gone")
    twice = found.groupBy("doc_id", "tk").agg(F.count("*").alias("c")).where("c > 1")
    asked = staged(gone.select("doc_id").union(twice.select("doc_id")).distinct(), "asked")
    named = F.col(key).cast("long")
    maybe = key_filter(asked, "doc_id")(named) & F.col(key).isNotNull()
    touched = docs.where(maybe).select(
        named.alias("doc_id"), F.xxhash64(text).alias("tk"), F.struct("*").alias("row"))
    left = touched.join(gone, ["doc_id", "tk"], "left_anti").dropDuplicates(["doc_id", "tk"])
    return docs.where(~maybe).union(left.select("row.*"))
