"""Consecutive offsets in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut


def with_offsets(df: DataFrame, order: list, start: int, name: str = "offset") -> tuple[DataFrame, int]:
    """(df with consecutive offsets from `start` in the given order, number of rows). Rows are sorted by ranges, once, and
    stay in that order from partition to partition; only the counts of the partitions reach the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    counts = {r["__p"]: r["n"] for r in dealt.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    base, at = {}, start
    for p in sorted(counts):
        base[p] = at
        at += counts[p]
    if not counts:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__p", "__i"), 0
    first = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("__p"))
    place = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count a partition's rows
    return dealt.withColumn(name, (first + place).cast("long")).drop("__p", "__i"), at - start
