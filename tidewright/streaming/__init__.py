"""Continuous queries by Structured Streaming, where watermarks follow the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import shared_folder


def tumbling_counts(spark: SparkSession, source: str, pattern: str, time: str = "ts", key: str = "event_type", size: str = "1 day", lag: str = "0 seconds") -> DataFrame:
    """Counts of closed tumbling windows over the files in a folder that fit a pattern, up to all that is there now. A window closes when the latest
    time less `lag` reaches its end; late rows are dropped. Results and state are kept in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.option("pathGlobFilter", pattern).parquet(source).schema).option("pathGlobFilter", pattern).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    counts = stream.withWatermark(time, lag).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), key, "n")
    q = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out").withColumn("day", F.col("day").cast("timestamp_ntz"))
