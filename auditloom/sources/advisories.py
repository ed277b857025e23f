"""Advisory records staged as a table; tasks make no network calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import schemas


def advisories(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Advisories keyed by ecosystem, name and version from Parquet or JSON lines."""
    return spark.read.schema(schemas.ADVISORIES).format(fmt).load(path)


def advisories_from_replies(replies: DataFrame) -> DataFrame:
    """Advisories of staged lookup replies (ecosystem, name, version, reply JSON)."""
    reply = F.from_json(
        "reply",
        "vulns array<struct<id:string,summary:string,database_specific:struct<severity:string>>>",
    )
    return replies.select(
        "ecosystem", "name", "version", F.explode(reply["vulns"]).alias("v")
    ).select(
        "ecosystem",
        "name",
        "version",
        "v.id",
        "v.summary",
        F.col("v.database_specific.severity").alias("severity"),
    )
