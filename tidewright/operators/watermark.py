"""Watermarks that follow the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_late(df: DataFrame, time: str, arrival: str, lag: str, size: str, bucket: int = 1_000_000) -> DataFrame:
    """Rows whose tumbling window of `size` was open when they arrived: the watermark is the latest time of all earlier
    arrivals minus `lag`. A prefix maximum over buckets of arrivals (whole numbers) keeps any one task to one bucket."""
    b = F.floor(F.col(arrival) / bucket)
    tops = df.groupBy(b.alias("__b")).agg(F.max(time).alias("__m"))
    before = tops.select("__b", F.max("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = Window.partitionBy("__b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__b", b).join(before, "__b").withColumn("__w", F.greatest(F.max(time).over(own), F.col("__before")) - F.expr(f"interval {lag}"))
    end = F.window(time, size).end - F.expr("interval 1 millisecond")
    return out.withColumn("__end", end).where("__w is null or __end > __w").drop("__b", "__before", "__w", "__end")
