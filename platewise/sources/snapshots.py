"""Versioned table snapshots on plain parquet (no MERGE needed).

A snapshot table is a folder partitioned by ``version``.  Publishing writes a
new version with dynamic partition overwrite (re-running the same version
replaces only that version, so a retried job is idempotent) and never
touches the versions being read; readers take the newest version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_COL = "version"


def write_version(df: DataFrame, root: str, version: int, extra_partitions: tuple[str, ...] = ()) -> None:
    """Write ``df`` as ``version`` (optionally also partitioned by ``extra_partitions``)."""
    (df.withColumn(VERSION_COL, F.lit(int(version)).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(VERSION_COL, *extra_partitions).parquet(root))


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Newest version number (optionally below ``before``); None when there is none."""
    try:
        versions = spark.read.parquet(root).select(VERSION_COL)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":  # nothing published yet; all else is a fault
            raise
        return None
    if before is not None:
        versions = versions.where(F.col(VERSION_COL) < before)
    return versions.agg(F.max(VERSION_COL)).first()[0]


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """One version (default: the newest) without the version column; None if none."""
    v = latest_version(spark, root) if version is None else version
    if v is None:
        return None
    return spark.read.parquet(root).where(F.col(VERSION_COL) == v).drop(VERSION_COL)


def publish(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version and return its number."""
    current = latest_version(df.sparkSession, root)
    nxt = 1 if current is None else current + 1
    write_version(df, root, nxt)
    return nxt
