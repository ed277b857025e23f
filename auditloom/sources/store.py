"""The stored scans: upsert, retention, reads, versioned folders and the bucketed store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import durable

RETENTION_DAYS = 30
RETAINED_SCANS = 50
RECENT_SCANS = 50
STORE_BUCKETS = 256


def upsert_scans(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing scans without those that come again, plus the new ones; of new ones with one
    id the one created last."""
    rest = [c for c in new.columns if c != "scan_id"]
    newest = F.col("created_at") if "created_at" in rest else F.struct(*rest)
    one = new.groupBy("scan_id").agg(F.max_by(F.struct(*rest), newest).alias("_row")).select(
        "scan_id", "_row.*"
    )
    return existing.join(one.select("scan_id"), "scan_id", "left_anti").unionByName(one)


def retain_scans(
    scans: DataFrame,
    now: datetime,
    days: int = RETENTION_DAYS,
    limit: int | None = None,
) -> DataFrame:
    """Scans of the last ``days`` (at least one), newest first, at most ``limit`` if given."""
    cutoff = F.lit(now) - F.expr(f"INTERVAL {max(1, days)} DAYS")
    return recent_scans(scans.filter(F.col("created_at") >= cutoff), limit)


def recent_scans(scans: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = scans.orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def get_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.filter(F.col("scan_id") == scan_id)


def scan_list(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans without their findings, with a finding count."""
    counts = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        scans.join(counts, "scan_id", "left")
        .withColumn("finding_count", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def store_metrics(
    scans: DataFrame, findings: DataFrame, limit: int | None = None
) -> DataFrame:
    """Stored scans and findings, of all scans or of the ``limit`` most recent ones."""
    recent = (scans if limit is None else recent_scans(scans, limit)).select("scan_id")
    held = findings.select("scan_id").join(recent, "scan_id", "left_semi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = recent.select(one.alias("scan"), none.alias("finding")).unionByName(
        held.select(none.alias("scan"), one.alias("finding"))
    )
    return rows.agg(
        F.coalesce(F.sum("scan"), none).alias("scans_stored"),
        F.coalesce(F.sum("finding"), none).alias("findings_stored"),
    )


def write_version(df: DataFrame, path: str, version: int, sort_by: str = "created_at") -> None:
    """One immutable version of a table; writing it again replaces only itself."""
    ordered = df.sortWithinPartitions(F.col(sort_by).desc()) if sort_by in df.columns else df
    ordered.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


@dataclass(frozen=True)
class BucketedStore:
    """Scans in one folder per bucket of their ids.

    A look-up opens the files of one bucket and an upsert rewrites only buckets
    of ids that come. The number of buckets stands in the folders' names, so a
    store that is opened with another number fails instead of missing rows.
    """

    path: str
    buckets: int = STORE_BUCKETS

    @property
    def _column(self) -> str:
        return f"bucket_of_{self.buckets}"

    def _bucket(self, scan_id: Column) -> Column:
        return F.pmod(F.xxhash64(scan_id.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, scans: DataFrame, mode: str) -> None:
        """Large buckets are cut to several tasks, small ones put together; ids are sorted in each
        file, so that a look-up passes by most row groups too."""
        placed = scans.withColumn(self._column, self._bucket(F.col("scan_id")))
        dealt = placed.hint("rebalance", F.col(self._column)).sortWithinPartitions(self._column, "scan_id")
        dealt.write.mode(mode).partitionBy(self._column).option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(self.path)

    def create(self, scans: DataFrame) -> None:
        """Writes the first scans; fails where a store is."""
        self._write(scans, "errorifexists")

    def upsert(self, new: DataFrame) -> None:
        """Replaces stored scans by new ones with their id and adds the others.

        The merged buckets are written aside first, then put in place of the old ones. The same
        upsert again gives the same store, also after one that broke off. One writer at a time.
        """
        spark = new.sparkSession
        held = durable(new.select(*self._stored(spark).drop(self._column).columns))
        touched = [r[0] for r in held.select(self._bucket(F.col("scan_id"))).distinct().collect()]
        if touched:  # at most as many numbers as buckets
            old = self._stored(spark).filter(F.col(self._column).isin(touched)).drop(self._column)
            self._write(durable(upsert_scans(old, held)), "overwrite")

    def _stored(self, spark: SparkSession) -> DataFrame:
        stored = spark.read.parquet(self.path)
        if self._column not in stored.columns:
            raise ValueError(f"{self.path} has no {self._column}: another number of buckets")
        return stored

    def scans(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(self._column)

    def find(self, spark: SparkSession, scan_id: str) -> DataFrame:
        """The scan of that id, from the files of its bucket alone."""
        own = F.col(self._column) == self._bucket(F.lit(scan_id))
        return get_scan(self._stored(spark).filter(own), scan_id).drop(self._column)
