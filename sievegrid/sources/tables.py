"""Parquet table scans by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; `sf_dir/name.parquet` may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
