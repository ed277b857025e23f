"""Fixed-window rate verdicts per client and category.

A window starts at a request; the first request more than one window length
after that start begins the next one. Refused requests count as well.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.streaming.sinks import ONCE, write_batch

# Executors get this module's functions by value; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_MS = 60_000
BLOCK_WINDOWS = 20

# Requests allowed per window by category.
LIMITS = {"scan": 6, "api": 120}

KEY = ["client", "category"]
BLOCK_KEY = [*KEY, "block"]
VERDICT = (
    "event_id bigint, client string, category string, ts_ms bigint, window_start bigint, "
    "position bigint"
)


def _limit(limits: dict[str, int]) -> Column:
    expr = None
    for name, value in limits.items():
        hit = F.col("category") == name
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def _judged(windows: DataFrame, limits: dict[str, int]) -> DataFrame:
    return windows.withColumn("allowed", F.col("position") <= _limit(limits))


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut so that no (client, category, block) is split."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        last = pdf.iloc[-1]
        same = (pdf[BLOCK_KEY] == last[BLOCK_KEY]).all(axis=1).to_numpy()
        if same.all():
            begins = 0
            if held and (held[-1].iloc[-1][BLOCK_KEY] != last[BLOCK_KEY]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
        else:
            begins = len(same) - int(np.argmin(same[::-1]))
            yield pd.concat([*held, pdf.iloc[:begins]], ignore_index=True)
            held = []
        held.append(pdf.iloc[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)


class _Blocks:
    """Row arithmetic over many whole blocks at once.

    Every block gets its own stretch of a number line, wide enough that looking
    one window ahead of a row never reaches the stretch of the next block.
    """

    def __init__(self, pdf: pd.DataFrame, window: int, block_ms: int) -> None:
        changed = (pdf[BLOCK_KEY] != pdf[BLOCK_KEY].shift()).any(axis=1).to_numpy()
        self.group = np.cumsum(changed) - 1
        self.first = np.flatnonzero(changed)
        self.end = np.append(self.first[1:], len(pdf))
        self.begin_ms = pdf["block"].to_numpy()[self.first] * block_ms
        self.times = pdf["ts_ms"].to_numpy()
        self.window = window
        self.stretch = 4 * (block_ms + window)
        self.line = self._place(self.times, self.group)

    def _place(self, times: np.ndarray, group: np.ndarray) -> np.ndarray:
        return group * self.stretch + times - self.begin_ms[group] + 2 * self.window

    def after(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """First row of the group more than one window after each start, or its end."""
        at = np.searchsorted(self.line, self._place(starts, group) + self.window, side="right")
        return np.minimum(at, self.end[group])


def _block_exits(window: int, block_ms: int):
    """For the times at which the first window of a block may begin, where its last one does."""

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches):
            b = _Blocks(pdf, window, block_ms)
            rows = np.arange(len(pdf))
            following = b.after(b.times, b.group)
            reach = np.where(following < b.end[b.group], following, rows)
            while not np.array_equal(reach[reach], reach):
                reach = reach[reach]
            groups = np.arange(len(b.first))
            entry = rows <= b.after(b.begin_ms, groups)[b.group]
            # Exits never decrease: the last entry of each run of equal exits is enough.
            last = np.append(
                (reach[1:] != reach[:-1]) | (b.group[1:] != b.group[:-1]) | ~entry[1:], True
            )
            entry &= last
            out = pdf.loc[entry, BLOCK_KEY].copy()
            out["entry_ms"], out["exit_ms"] = b.times[entry], b.times[reach[entry]]
            yield out

    return exits


def _chain_blocks(window: int):
    """Walks the sorted entries of each key: one row per block with the window in force."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block, start, entered = None, None, None, False
        for pdf in batches:
            rows = []
            columns = (pdf[c] for c in (*BLOCK_KEY, "entry_ms", "exit_ms"))
            for client, category, at, entry, leave in zip(*columns):
                if (client, category) != key:
                    key, block, start = (client, category), None, None
                if at != block:
                    block, entered = at, False
                    rows.append((client, category, at, start))
                if not entered and (start is None or entry > start + window):
                    start, entered = leave, True
            out = pd.DataFrame(rows, columns=[*BLOCK_KEY, "start_ms"])
            yield out.astype({"start_ms": "Int64"})

    return chain


def _number_requests(window: int, block_ms: int):
    """Window start and position of the requests of each block, from the window in force."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches):
            b = _Blocks(pdf, window, block_ms)
            rows, groups = np.arange(len(pdf)), np.arange(len(b.first))
            own = pdf["own"].to_numpy(dtype=bool)
            given = pd.array(pdf["start_ms"], dtype="Int64")[b.first]
            known = ~np.asarray(given.isna())
            # Without a window in force the first own request opens one.
            start = np.where(known, given.fillna(0).to_numpy(dtype="int64"), b.begin_ms)
            own_first = np.minimum.reduceat(np.where(own, rows, len(pdf)), b.first)
            at = np.where(known, np.maximum(b.after(start, groups), own_first), own_first)
            opens = np.zeros(len(pdf), dtype=bool)
            live = groups
            while len(live):
                live = live[at[live] < b.end[live]]
                opens[at[live]] = True
                at[live] = b.after(b.times[at[live]], live)
            # Rows before the first opening count from the start of the carried window.
            carried = np.searchsorted(b.line, b._place(start, groups), side="left")
            opened = np.maximum.accumulate(np.where(opens, rows, -1))
            inside = opened >= b.first[b.group]
            origin = np.where(inside, opened, carried[b.group])
            begun = np.where(inside, b.times[np.maximum(opened, 0)], start[b.group])
            out = pdf[["event_id", *KEY, "ts_ms"]].assign(
                window_start=begun, position=rows - origin + 1
            )
            yield out[own]

    return number


def rate_verdicts(
    requests: DataFrame,
    window_ms: int = WINDOW_MS,
    limits: dict[str, int] = LIMITS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Verdict of every request of a table.

    The windows of a key form a chain, but a busy client must not be worked off
    in one task. Time is cut into blocks of some windows. Every block finds, for
    each time at which its first window may begin, where its last one begins;
    only these entries, a small share of the distinct times, are walked in order
    per key. With the window in force at its begin each block is then numbered
    by itself. The last window length of a block is repeated in the next one, so
    that a window across the border is counted whole.
    """
    block_ms = window_ms * block_windows
    block = F.floor(F.col("ts_ms") / block_ms)
    timed = requests.select(
        "event_id", *KEY, F.unix_millis("ts").alias("ts_ms")
    ).withColumn("block", block)

    entries = (
        timed.select(*BLOCK_KEY, "ts_ms")
        .distinct()
        .repartition(*BLOCK_KEY)
        .sortWithinPartitions(*BLOCK_KEY, "ts_ms")
        .mapInPandas(
            _block_exits(window_ms, block_ms),
            "client string, category string, block bigint, entry_ms bigint, exit_ms bigint",
        )
    )
    in_force = (
        entries.repartition(*KEY)
        .sortWithinPartitions(*BLOCK_KEY, "entry_ms")
        .mapInPandas(
            _chain_blocks(window_ms),
            "client string, category string, block bigint, start_ms bigint",
        )
    )
    tail = F.col("ts_ms") >= (F.col("block") + 1) * block_ms - window_ms
    copies = F.array_compact(
        F.array(
            F.struct(F.col("block").alias("block"), F.lit(True).alias("own")),
            F.when(tail, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    spread = timed.select("event_id", *KEY, "ts_ms", F.inline(copies))
    # A block without requests of its own has no row in in_force and drops out.
    numbered = (
        spread.join(in_force, BLOCK_KEY)
        .repartition(*BLOCK_KEY)
        .sortWithinPartitions(*BLOCK_KEY, "ts_ms", "event_id")
        .mapInPandas(_number_requests(window_ms, block_ms), VERDICT)
    )
    return _judged(numbered, limits)


def _count_stream(window: int):
    """Stateful twin: state is the start and the count of the window in force."""

    def count(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"], kind="stable")
        start, n = state.get if state.exists else (None, 0)
        starts, positions = [], []
        for at in pdf["ts_ms"].tolist():
            if start is None or at - start > window:
                start, n = at, 0
            n += 1
            starts.append(start)
            positions.append(n)
        state.update((start, n))
        yield pdf.assign(
            client=key[0], category=key[1], window_start=starts, position=positions
        )[["event_id", "client", "category", "ts_ms", "window_start", "position"]]

    return count


def rate_stream(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    window_ms: int = WINDOW_MS,
    limits: dict[str, int] = LIMITS,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Verdicts of arriving requests, late ones included.

    Within a batch requests are taken in time order; one that is older than the
    start of the window in force belongs to that window. The state of a key is
    two numbers and is kept, so no watermark drops a row.
    """
    keyed = requests.select(
        "event_id", *KEY, "ts", F.unix_millis("ts").alias("ts_ms")
    )
    counted = keyed.groupBy(*KEY).applyInPandasWithState(
        _count_stream(window_ms),
        VERDICT,
        "start bigint, n bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return (
        _judged(counted, limits)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_batch(batch, out, batch_id))
        .trigger(**trigger)
        .start()
    )
