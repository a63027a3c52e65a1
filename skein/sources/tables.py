"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
