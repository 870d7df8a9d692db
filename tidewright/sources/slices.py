"""Dataset slices: Parquet files in order, bounded by offsets, with the columns of a schema file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.model import Input


def utc(df: DataFrame, nanos: set[str] = frozenset()) -> DataFrame:
    """Times without zone as UTC instants; columns of nanoseconds, which Spark reads as numbers, too (cut to microseconds)."""
    times = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(times | {c: F.timestamp_micros(F.floor(F.col(f"`{c}`") / F.lit(1000).cast("decimal(4,0)")).cast("long")) for c in nanos if c in df.columns})


def nanosecond_columns(spark: SparkSession, path: str) -> set[str]:
    """Columns that a Parquet file (or the first of a folder) declares as times in nanoseconds, from its footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        parts = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet"))
        if not parts:
            return set()
        at = jvm.org.apache.hadoop.fs.Path(parts[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
    try:
        return set(re.findall(r"^\s*(?:required|optional) int64 (\S+) \(TIMESTAMP\(NANOS,", reader.getFooter().getFileMetaData().getSchema().toString(), re.M))
    finally:
        reader.close()


def read_slice(spark: SparkSession, source: Input) -> DataFrame:
    """The rows of a slice; without an interval none, with the columns of the schema file. Missing columns are null."""
    first = source.schema_file or source.paths[0]
    nanos = nanosecond_columns(spark, first)
    schema = utc(spark.read.parquet(first), nanos).schema
    if source.vocab.op not in schema.names:
        raise ValueError(f"Operation column not found: {source.vocab.op}")
    if source.vocab.event_time not in schema.names:
        raise ValueError(f"Event time column not found: {source.vocab.event_time}")
    if source.interval is None or not source.paths:
        return spark.createDataFrame([], schema)
    df = utc(spark.read.schema(spark.read.parquet(first).schema).parquet(*source.paths), nanos)
    return df.where(F.col(source.vocab.offset).between(*source.interval))
