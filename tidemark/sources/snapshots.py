"""Versioned tables and append-only logs on a shared file system, written idempotently by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, table: str, version: int) -> None:
    """Write the version's folder first and the row that points to it last; writing a version again replaces it."""
    df.write.mode("overwrite").parquet(f"{table}/data/version={version}")
    df.sparkSession.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{table}/published/p={version}")


def current_version(spark: SparkSession, table: str) -> int | None:
    try:
        return spark.read.schema("version long").parquet(f"{table}/published/*").agg(F.max("version")).first()[0]
    except Exception as e:  # noqa: BLE001 - only a table that was never published is no error
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The published version, or the one asked for."""
    version = current_version(spark, table) if version is None else version
    return spark.read.parquet(f"{table}/data/version={version}")


def append_events(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch; a batch that comes again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
