"""As-of joins with versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, versions: DataFrame, on: list[tuple[str, str]], left_time: str, version_time: str, name: str, tie: str | None = None, outer: bool = False, bucket: int | None = None) -> DataFrame:
    """left with a struct `name`: the version of its key with the latest time not after its own (null: none; dropped unless outer).

    Both sides are dealt by key once and sorted by time, versions first; the latest version is carried along. Of versions with
    equal times the one with the larger `tie` wins. bucket: seconds; for keys with more rows than a task should sort, they are
    dealt by key and bucket of time, and the last version before each bucket (one row a bucket) is carried into it."""
    keys = [f"__k{i}" for i in range(len(on))]
    v, x = F.struct(*[F.col(f"`{c}`") for c in versions.columns]), F.struct(*[F.col(f"`{c}`") for c in left.columns])
    none = F.lit(None)
    a = left.select(*[F.col(f"`{c}`").alias(k) for (c, _), k in zip(on, keys, strict=True)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), none.cast("long").alias("__tie"), x.alias("__x"), none.cast(versions.select(v.alias("v")).schema["v"].dataType).alias("__v"))
    b = versions.select(*[F.col(f"`{c}`").alias(k) for (_, c), k in zip(on, keys, strict=True)], F.col(version_time).alias("__t"), F.lit(0).alias("__side"), (F.col(tie).cast("long") if tie else none.cast("long")).alias("__tie"), none.cast(left.select(x.alias("x")).schema["x"].dataType).alias("__x"), v.alias("__v"))
    rows, dealt = a.unionByName(b), list(keys)
    if bucket:
        dealt.append("__b")
        rows = rows.withColumn("__b", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / (bucket * 1_000_000)))
        last = F.max_by("__v", F.when(F.col("__side") == 0, F.struct("__t", "__tie")))
        ends = rows.groupBy(*dealt).agg(last.alias("__v"), F.max("__side").alias("__side"))
        before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__v", F.last("__v", ignorenulls=True).over(before)).where("__side = 1 and __v is not null")
        rows = rows.unionByName(carried.withColumns({"__t": F.col(f"__v.`{version_time}`"), "__side": F.lit(0)}), allowMissingColumns=True)
    w = Window.partitionBy(*dealt).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = rows.withColumn("__v", F.when(known, F.last("__v", ignorenulls=True).over(w))).where("__side = 1")
    if not outer:
        out = out.where("__v is not null")
    return out.select("__x.*", F.col("__v").alias(name))


def snapshot(versions: DataFrame, key: list[str], time: str, at, tie: str | None = None) -> DataFrame:
    """The newest version of each key as of a constant time. Aggregated before the shuffle; no sort of a key's versions."""
    order = F.struct(F.col(time), *([F.col(tie)] if tie else []))
    row = F.struct(*[F.col(c) for c in versions.columns])
    return versions.where(F.col(time) <= F.lit(at)).groupBy(*key).agg(F.max_by(row, order).alias("__row")).select("__row.*")
