"""Writes results to exact paths and keeps small state next to tables, through Spark's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_file(df: DataFrame, path: str) -> None:
    """One Parquet file at exactly `path`, in the order of df's partitions. The format of datasets asks for one file a slice,
    so one task writes it: a slice, not the history, must be what a task can write."""
    spark = df.sparkSession
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(tmp)
    fs, p = _fs(spark, path)
    part = next(s.getPath() for s in fs.listStatus(_fs(spark, tmp)[1]) if s.getPath().getName().startswith("part-"))
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    if not fs.rename(part, p):
        raise OSError(f"Can't write {path}")
    fs.delete(_fs(spark, tmp)[1], True)


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
