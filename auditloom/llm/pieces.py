"""SentencePiece encoding and decoding by matching all pieces in a suffix array.

The different words of a batch are joined and indexed; every piece is found by binary search as
a range of suffixes, and the occurrences, sorted by position, are the edges of a lattice. Words
start as single characters and are relaxed along the edges: in each round every word takes
its best-scored edge over two neighbouring tokens, the leftmost in a tie, until none is left.
That is the order in which a byte-pair model merges. Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import slices, utf8
from auditloom.llm.suffixes import SEPARATOR, _words, suffix_array

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
LONG_WORD = 60  # longer words are merged one by one with a heap
BATCH_BYTES = 2_500_000  # texts whose new words are matched together
HELD_WORDS = 300_000  # words whose ids a task remembers

_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Model:
    """Pieces of a byte-pair SentencePiece model without normaliser, with byte fallback."""

    ids: dict[str, int]
    scores: np.ndarray
    bytes_: list[int]
    surface: list[bytes]
    unknown: int = 0
    held: dict = field(default_factory=dict)


def load(path: str) -> Model:
    """Reads a model file; the driver reads it and broadcasts the result."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
    if train.model_type != 2 or not (plain and norm.add_dummy_prefix and train.byte_fallback):
        raise ValueError("only byte-pair models without normaliser, with byte fallback, are read")
    ids, bytes_, surface, unknown = {}, [0] * 256, [], 0
    for i, p in enumerate(proto.pieces):
        surface.append(b"")
        if p.type == NORMAL:
            if SPACE in p.piece.lstrip(SPACE):
                raise ValueError("a piece runs over the start of a word")
            ids[p.piece] = i
            surface[i] = p.piece.replace(SPACE, " ").encode()
        elif p.type == BYTE:
            bytes_[int(p.piece[3:5], 16)] = i
            surface[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == UNKNOWN:
            unknown, surface[i] = i, " ⁇ ".encode()
        elif p.type == USER:
            raise ValueError("user-defined pieces are not read")
    return Model(ids, np.array([p.score for p in proto.pieces]), bytes_, surface, unknown)


# --- edges ----------------------------------------------------------------------------------------


def _search(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as rows of eight-byte words, masks of their length, lengths and ids."""
    if "search" not in model.held:
        raw = [(p.encode(), i) for p, i in model.ids.items()]
        n = -(-max(len(b) for b, _ in raw) // 8)
        lengths = np.array([len(b) for b, _ in raw])
        table = np.frombuffer(b"".join(b.ljust(8 * n, b"\0") for b, _ in raw), ">u8").reshape(-1, n)
        mask = np.frombuffer(
            b"".join((b"\xff" * len(b)).ljust(8 * n, b"\0") for b, _ in raw), ">u8").reshape(-1, n)
        model.held["search"] = (table.astype(np.uint64), mask.astype(np.uint64), lengths,
                                np.array([i for _, i in raw]))
    return model.held["search"]


def _key(start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Position and length as one number; pieces are shorter than 64 bytes."""
    return ((start << 6) | np.minimum(length, 63)).astype(np.int32 if size < 1 << 24 else np.int64)


def edges(model: Model, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all occurrences of pieces, sorted by position, and their piece ids."""
    table, mask, lengths, ids = _search(model)
    wide = table.shape[1]
    words = _words(data, 8 * wide + 8)
    order = suffix_array(data, words, enough=8 * wide)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(order), np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            at = order[np.minimum(middle, len(order) - 1)]
            less, same = np.zeros(len(ids), bool), np.ones(len(ids), bool)
            for k in range(wide):
                w = words[at + 8 * k] & mask[:, k]
                less |= same & (w < table[:, k])
                same &= w == table[:, k]
            right = (less | same if after else less) & (low < high)
            low = np.where(right, middle + 1, low)
            high = np.where(right | (low >= high), high, middle)
        return low

    first, last = bound(False), bound(True)
    n = np.maximum(last - first, 0)
    run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = order[np.repeat(first, n) + run]
    keys = _key(at, np.repeat(lengths, n), len(data))
    by = np.argsort(keys)
    return keys[by], np.repeat(ids, n)[by]


def _relax(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of moderate length, all words together, and their number per word."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(SEPARATOR.join(raw) + SEPARATOR, np.uint8)
    keys, ids = edges(model, data)

    def look(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = _key(start, end - start, len(data))
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        return np.where(keys[at] == key, ids[at], -1) if len(keys) else np.full(len(key), -1)


    begins = np.cumsum([0] + [len(b) + 1 for b in raw])
    start = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0xFF))
    word = np.searchsorted(begins, start, side="right") - 1
    final = np.r_[word[1:] != word[:-1], True]
    end = np.where(final, begins[word + 1] - 1, np.r_[start[1:], 0])
    pair = np.full(len(start), -1)
    pair[~final] = look(start[~final], end[1:][~final[:-1]])
    out: list[tuple[np.ndarray, ...]] = []
    while len(start):
        score = np.where(pair >= 0, model.scores[pair], -np.inf)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[heads, len(start)])
        best = np.repeat(np.maximum.reduceat(score, heads), sizes)
        done = best == -np.inf
        out.append((start[done], end[done], word[done]))
        hit = np.flatnonzero((score == best) & ~done)
        if not len(hit):
            break
        hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]  # the leftmost of a word
        end[hit] = end[hit + 1]
        keep = ~done
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        start, end, word, pair = start[keep], end[keep], word[keep], pair[keep]
        # only pairs beside a merge have changed
        beside = np.zeros(len(start) + 1, bool)
        beside[at] = beside[at - 1] = True  # the last place takes what stands before the first
        pair[beside[:-1]] = -1
        again = np.flatnonzero(beside[:-1][:-1] & (word[1:] == word[:-1]))
        pair[again] = look(start[again], end[again + 1])
    start, end, word = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))
    by = np.argsort(start)
    start, end, word = start[by], end[by], word[by]
    piece = look(start, end)
    n = np.where(piece >= 0, 1, end - start)
    first = np.cumsum(n) - n
    token = np.repeat(np.arange(len(n)), n)
    byte = data[start[token] + np.arange(len(token)) - first[token]]
    ids_out = np.where(piece[token] >= 0, piece[token], np.array(model.bytes_)[byte]).astype(np.int32)
    return ids_out, np.bincount(word, n, len(words)).astype(np.int64)


def _merge_long(model: Model, word: str) -> list[int]:
    """Ids of one long word: the same order of merges, kept in a heap."""
    parts: list[str | None] = list(word)
    after, prior = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(parts):
            both = parts[i] + parts[after[i]]
            if (k := model.ids.get(both)) is not None:
                heapq.heappush(heap, (-model.scores[k], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[i] < len(parts):
            prior[after[i]] = i
        offer(i)
        offer(prior[i])
    out: list[int] = []
    for p in parts:
        if p is not None:
            k = model.ids.get(p)
            out += [k] if k is not None else [model.bytes_[c] for c in p.encode()]
    return out


class Words:
    """Ids of the words seen so far: a number per word, where its ids stand, and whether a later
    call met it again."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def learn(self, model: Model, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LONG_WORD]
        long_ = [w for w in words if len(w) > LONG_WORD]
        ids, counts = _relax(model, short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        merged = [_merge_long(model, w) for w in long_]
        self.number.update(zip(short + long_, range(len(self.number), len(self.number) + len(words))))
        self.ids = np.concatenate([self.ids, ids, *(np.array(m, np.int32) for m in merged)])
        sizes = np.concatenate([counts, np.array([len(m) for m in merged], np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and where each word's begin and the last ends."""
        first, last = self.ends[number], self.ends[number + 1]
        upto = np.r_[0, np.cumsum(last - first)]
        at = np.repeat(first - upto[:-1], last - first) + np.arange(upto[-1])
        return self.ids[at], upto

    def only(self, stay: np.ndarray) -> Words:
        """The words marked in ``stay``, none of them met again so far."""
        out = Words()
        out.ids, out.ends = self.gather(np.flatnonzero(stay))
        out.number = {w: i for i, w in enumerate(compress(self.number, stay))}  # they stand by number
        out.again = np.zeros(len(out.number), bool)
        return out


def encode_flat(model: Model, texts: list[str], held: dict[str, Words]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of each. ``held`` remembers words from call
    to call, up to HELD_WORDS; when it is full, words that were met in one call only go."""
    split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    words = held.setdefault("words", Words())
    found = set().union(*split)
    new = found - words.number.keys()
    if len(words.number) + len(new) > HELD_WORDS:
        here = np.zeros(len(words.number), bool)
        here[[words.number[w] for w in found - new]] = True
        stay = words.again | here
        words = held["words"] = words.only(stay if stay.sum() + len(new) <= HELD_WORDS else here)
    known = len(words.number)
    if new:
        words.learn(model, list(new))
    sizes = np.array([len(ws) for ws in split], np.int64)
    number = np.fromiter(map(words.number.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
    words.again[number] = True
    words.again[known:] = False
    ids, upto = words.gather(number)
    return ids, upto[np.r_[0, np.cumsum(sizes)]]


def encode(model: Model, texts: list[str], held: dict[str, Words]) -> list[list[int]]:
    """Ids of each text as lists, see encode_flat."""
    flat, offsets = encode_flat(model, texts, held)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def decode(model: Model, ids: list[int]) -> str:
    """Text of ids; the space that encoding puts ahead of a text is taken off again."""
    raw = b"".join(map(model.surface.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


# --- DataFrames -----------------------------------------------------------------------------------


def encoded(docs: DataFrame, model: Model, text: str = "text", verify: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>), with ``verify`` also ``round_trip``: whether they decode to the text.

    Null and empty texts get an empty array; a text of any length is encoded whole. Input columns
    of these names are replaced, others pass through. Only a text that holds U+2581, which
    stands for a space, or a character cut in two does not decode to itself.
    """
    kept = docs.drop("ids", *["round_trip"] * verify)
    at = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.held  # words are remembered from task to task of a worker
        for batch in batches:
            raw = utf8(batch.column(at))
            for a, b in slices(raw, BATCH_BYTES):
                flat, offsets = encode_flat(shared.value, [r.decode() for r in raw[a:b]], held)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                part = batch.slice(a, b - a)
                more, names = [ids], ["ids"]
                if verify:
                    same = [decode(shared.value, flat[i:j].tolist()).encode() == r for i, j, r in zip(
                        offsets[:-1].tolist(), offsets[1:].tolist(), raw[a:b])]
                    more, names = [ids, pa.array(same, pa.bool_())], ["ids", "round_trip"]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, ids array<int>" + ", round_trip boolean" * verify)


def decoded(tokens: DataFrame, model: Model, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids give null. A column of that name is replaced."""
    kept = tokens.drop(to)
    at = kept.columns.index(ids)
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            out = [decode(shared.value, k.values.to_pylist()) if k.is_valid else None for k in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                             [*batch.schema.names, to])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, `{to}` string")
