"""Tables that streams write batch by batch and that readers merge."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom.session import per_scan

ONCE = {"availableNow": True}  # trigger: everything that is there, then stop
GENERATIONS = "_generations"  # Spark's readers pass by names with this beginning
FOLD_EVERY = 50  # batches between two generations; the most that a reader opens beside one


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """One micro-batch; a repeated batch replaces only its own folder."""
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def _shared(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def _numbers(spark: SparkSession, folder: str, label: str) -> list[int]:
    """Numbers of the ``label=<n>`` folders, by one listing of names."""
    system, path = _shared(spark, folder)
    if not system.exists(path):
        return []
    names = (status.getPath().getName() for status in system.listStatus(path))
    return sorted(int(m[1]) for m in (re.fullmatch(rf"{label}=(\d+)", n) for n in names) if m)


def _generation(folder: str, number: int) -> str:
    return f"{folder}/{GENERATIONS}/upto={number}"


def newest_generation(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Last batch that the newest whole generation holds, or None; of those ``before`` a batch, if given."""
    for number in reversed(_numbers(spark, f"{folder}/{GENERATIONS}", "upto")):
        if before is None or number < before:
            system, mark = _shared(spark, f"{_generation(folder, number)}/_SUCCESS")
            if system.exists(mark):
                return number
    return None


def read_since(
    spark: SparkSession, folder: str, generation: int | None, before: int | None = None
) -> DataFrame:
    """A generation and the batches behind it; all batches where there is none.

    Only those folders are opened, at most as many batches as lie between two generations.
    """
    if generation is None:
        written = read_batches(spark, folder)
        return written if before is None else written.filter(F.col("batch_id") < before)
    rows = spark.read.parquet(_generation(folder, generation))
    later = [
        f"{folder}/batch_id={n}"
        for n in _numbers(spark, folder, "batch_id")
        if n > generation and (before is None or n < before)
    ]
    if not later:
        return rows
    return rows.unionByName(spark.read.schema(rows.schema).option("basePath", folder).parquet(*later))


def write_generation(df: DataFrame, folder: str, batch_id: int) -> None:
    """What readers need of all batches up to this one; df keeps the column batch_id."""
    df.write.mode("overwrite").parquet(_generation(folder, batch_id))


def fold_due(spark: SparkSession, folder: str, batch_id: int, every: int) -> bool:
    """Whether ``every`` batches have passed since the last generation before this batch.

    A repeated batch comes to the same answer, unless its generation is whole already.
    """
    if newest_generation(spark, folder, batch_id + 1) == batch_id:
        return False
    last = newest_generation(spark, folder, batch_id)
    return batch_id - (-1 if last is None else last) >= every


def fold_batches(
    spark: SparkSession,
    folder: str,
    batch_id: int,
    reduced: Callable[[DataFrame], DataFrame],
    every: int = FOLD_EVERY,
) -> None:
    """Writes a generation, if one is due: the last one and the batches since, ``reduced``.

    Nothing is deleted: batches stay as the log, and readers that began with an earlier generation
    end with it. A generation counts once it is whole. A stream that begins anew, with another
    checkpoint, needs a folder of its own.
    """
    if fold_due(spark, folder, batch_id, every):
        last = newest_generation(spark, folder, batch_id)
        held = reduced(read_since(spark, folder, last, batch_id + 1))
        write_generation(held, folder, batch_id)


def read_before(
    spark: SparkSession, folder: str, batch_id: int, schema: StructType, generation: int | None = None
) -> DataFrame:
    """Rows that batches before this one have written, none where nothing was written yet.

    A repeated batch sees what it saw the first time, not its own rows. ``generation`` is one before
    the batch, to be read in place of the batches it holds.
    """
    try:
        return read_since(spark, folder, generation, batch_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))


def newest_by(df: DataFrame, keys: Sequence[str], version: str = "batch_id") -> DataFrame:
    """Rows of the newest batch of each key; replaces what earlier batches held for it."""
    last = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(per_scan(last), [*keys, version], "left_semi")
