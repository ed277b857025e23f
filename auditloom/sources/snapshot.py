"""Snapshot folders as a Spark data source.

Built-in file sources hide names that start with a dot or an underscore, which are ordinary
source files here, so the folders are walked by a Python source. Filters on the snapshot, the kind
and the size of a file are pushed into the walk: a file that they rule out is never opened, and
with the listing alone no file is. Ignored directories are not entered.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from auditloom.operators.files import IGNORED_DIRECTORIES, MANIFEST_NAMES, TEXT_EXTENSIONS

# Executors get this module's functions by value; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "scan_id string, path string, entry_type string, length bigint, kind string, content string"
LISTING = ("scan_id", "path", "entry_type", "length", "kind")

UNITS_PER_PARTITION = 16
SPLIT_BELOW = 256  # with fewer folders to read, their own folders are read apart, level by level
ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 32_000_000


def kind_of(name: str) -> str | None:
    """``manifest`` or ``text`` for names that are scanned. A name like ``.env`` has no extension."""
    if name in MANIFEST_NAMES:
        return "manifest"
    stem, dot, ending = name.rpartition(".")
    return "text" if stem and (dot + ending).lower() in TEXT_EXTENSIONS else None


def _decoded(name: str) -> str:
    """Names are bytes; odd ones keep a replacement character, as contents do."""
    return os.fsencode(name).decode("utf-8", errors="replace")


_TESTS = {
    EqualTo: lambda held, value: held is not None and held == value,
    EqualNullSafe: lambda held, value: held == value,
    In: lambda held, value: held is not None and held in value,
    IsNotNull: lambda held, value: held is not None,
    LessThan: lambda held, value: held is not None and held < value,
    LessThanOrEqual: lambda held, value: held is not None and held <= value,
    GreaterThan: lambda held, value: held is not None and held > value,
    GreaterThanOrEqual: lambda held, value: held is not None and held >= value,
    StringStartsWith: lambda held, value: held is not None and held.startswith(value),
}


class Folders(InputPartition):
    """Units (scan, folder below it, whether its folders belong to it) of one task."""

    def __init__(self, units: list[tuple[str, str, bool]]) -> None:
        super().__init__(None)
        self.units = units


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.contents = options.get("contents", "true").lower() == "true"
        self.per_partition = int(options.get("unitsperpartition", UNITS_PER_PARTITION))
        self.split_below = int(options.get("splitbelow", SPLIT_BELOW))
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the walk can decide without opening a file; the rest is left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and len(column) == 1 and column[0] in LISTING:
                self.tests.append((column[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, **known: Any) -> bool:
        return all(_TESTS[kind](known[c], value) for c, kind, value in self.tests if c in known)

    def _scans(self) -> list[str]:
        """Snapshots by name if the filters name them, else all that the filters leave."""
        named = [value if kind is In else [value] for c, kind, value in self.tests
                 if c == "scan_id" and kind in (EqualTo, In)]
        if named:
            # a name that leads out of the root is no snapshot
            found = {x for x in named[0] if x and os.path.basename(x) == x and x not in (".", "..")}
            found = {x for x in found if os.path.isdir(os.path.join(self.root, x))
                     and not os.path.islink(os.path.join(self.root, x))}
        else:
            found = {e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)}
        return sorted(x for x in found if self._wanted(scan_id=_decoded(x)))

    def partitions(self) -> list[InputPartition]:
        """Few folders per task. Where snapshots are few, their folders are dealt out apart, so that
        a very large one is not one task; that takes at most about ``splitbelow`` listings here."""
        units = [(name, "", True) for name in self._scans()]
        split = self.split_below
        while len(units) < split:
            finer = []
            for scan, below, deep in units:
                folders = self._folders(os.path.join(self.root, scan, below)) if deep else []
                finer += [(scan, below, False)] if folders else [(scan, below, deep)]
                finer += [(scan, os.path.join(below, f), True) for f in folders]
            if len(finer) == len(units):
                break
            units = finer
        step = self.per_partition if len(units) >= split else 1
        return [Folders(units[i : i + step]) for i in range(0, len(units), step)]

    @staticmethod
    def _folders(folder: str) -> list[str]:
        return sorted(e.name for e in os.scandir(folder)
                      if e.is_dir(follow_symlinks=False) and e.name not in IGNORED_DIRECTORIES)

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa

        names = [*LISTING, "content"]
        schema = pa.schema([(n, pa.int64() if n == "length" else pa.string()) for n in names])
        rows: list[dict] = []
        held = 0
        for scan, below, deep in partition.units:
            for row in self._walk(scan, os.path.join(self.root, scan, below), below, deep):
                rows.append(row)
                held += len(row["content"] or "")
                if len(rows) >= ROWS_PER_BATCH or held >= BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _walk(self, scan: str, folder: str, below: str, deep: bool) -> Iterator[dict]:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            inner = f"{below}/{entry.name}" if below else entry.name
            if entry.is_symlink():
                row = self._row(scan, inner, "symlink", 0, None)
            elif entry.is_dir():
                if deep and entry.name not in IGNORED_DIRECTORIES:
                    yield from self._walk(scan, entry.path, inner, deep)
                continue
            elif entry.is_file():
                row = self._row(scan, inner, "file", entry.stat().st_size, kind_of(entry.name))
            else:
                continue
            if not self._wanted(**{c: row[c] for c in LISTING}):
                continue
            if self.contents and row["entry_type"] == "file":
                with open(entry.path, "rb") as f:
                    row["content"] = f.read().decode("utf-8", errors="replace")
            yield row

    @staticmethod
    def _row(scan: str, path: str, entry_type: str, length: int, kind: str | None) -> dict:
        return {"scan_id": _decoded(scan), "path": _decoded(path), "entry_type": entry_type,
                "length": length, "kind": kind, "content": None}


class SnapshotSource(DataSource):
    """Format ``snapshot``: a folder of snapshot folders, readable by every executor."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def _source(spark: SparkSession, root: str, contents: bool) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot").option("contents", str(contents).lower()).load(root)


def snapshot_listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows (scan_id, path, entry_type, length, kind) of all entries; no file is opened."""
    return _source(spark, root, contents=False).drop("content")


def snapshot_files(spark: SparkSession, root: str, max_file_bytes: int | None = None,
                   eligible: bool = False) -> DataFrame:
    """The ``files`` table of the snapshots below ``root``, every file read.

    With ``max_file_bytes`` larger files have no row here; ``snapshot_listing`` still has them, and
    ``scan_folders`` counts them as skipped. With ``eligible`` only files that are scanned come.
    Filters on scan_id, entry_type and length that follow are pushed into the walk as well.
    """
    files = _source(spark, root, contents=True)
    if eligible:
        files = files.where((F.col("entry_type") == "file") & F.col("kind").isNotNull())
    if max_file_bytes is not None:
        files = files.where(F.col("length") <= max_file_bytes)
    return files.select("scan_id", "path", "entry_type", "length", "content")
