"""Readers of whole Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` in `folder`; any path that Spark can read will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
