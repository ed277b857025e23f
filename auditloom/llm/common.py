"""Helpers shared by the operators: staged tables, key filters, components, byte arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import shared_folder

SLICE_BYTES = 500_000  # texts are taken together up to so many bytes
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2_000_000  # of a batch that goes to Python, or one row
KEY_BITS = 24  # a key filter has 2^24 bits: 2 MB, whatever the number of keys


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage is cut and a
    lost executor costs nothing that was finished. Spark drops the shuffle files of the write
    when it ends; else those of all steps stay until the driver collects its garbage. Batches for
    Python are cut by bytes: ten thousand texts would be held by Spark, its writer and the worker."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    wanted = {SHUFFLE_CLEANUP: "true", ARROW_BYTES: str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_filter(keys: DataFrame, key: str):
    """Function of a 64-bit column: false only where its value is not among ``keys``. It looks
    hashes up in a broadcast bit table of fixed size."""
    at = F.pmod(F.col(key), F.lit(1 << KEY_BITS))
    words = keys.where(F.col(key).isNotNull()).groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits")
    ).toPandas()  # at most 2^18 rows
    bits = np.zeros(1 << (KEY_BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        v = np.mod(k.fillna(0).to_numpy(np.int64), 1 << KEY_BITS)
        return pd.Series((held.value[v >> 6] >> (v & 63)) & 1 == 1)

    return maybe


def table_bits(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits, set at the lowest bits of the 64-bit ``key`` of every row."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    words = keys.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits")
    ).toPandas()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def with_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose 64-bit ``key`` (never null) is in ``keys``, joined exactly.

    The bit table goes ahead of the join and spares the shuffle of most other rows; with many
    more keys than bits it lets everything pass and only the join decides.
    """
    return df.where(key_filter(keys, key)(F.col(key))).join(keys.select(key), key, "left_semi")


def _stars(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is the least of its component."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("top")),
                             F.struct(F.col("v").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("top"))))
    told = pairs.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.low").alias("low"), F.sum("e.top").alias("top"))
    return told.where("low > 1 or (low = 1 and top > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of every id in ``edges`` (a, b: long): the smallest id reachable.

    Alternating large-star and small-star rounds; every round is a few reducing aggregations
    and joins whose hot hubs Spark can split, and its edges are written to the shared folder.
    """
    pairs = staged(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while not _stars(pairs):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(small.union(down).distinct(), "edges")
    tops = pairs.select(F.col("v").alias("id")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        tops.select("id", F.col("id").alias("component"))
    )


def folds(doc_id: str = "doc_id") -> F.Column:
    """True for documents held out of learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- bytes ---------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        _POWERS["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _POWERS["down"] = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
    return _POWERS["up"], _POWERS["down"]


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums S so that (S[j] - S[i]) * down[i] depends on the bytes i to j alone."""
    up, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=s[1:])
    return s


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Index ranges of texts that hold at most ``limit`` bytes together, or one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """Bytes of an Arrow string column; null as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
