"""Top-N as a changelog."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewright.model import APPEND, CORRECT_FROM, CORRECT_TO


def _rank(x):
    """A value that orders as Spark orders x: null lowest, NaN above all other numbers, zeros equal."""
    if x is None:
        return (0,)
    if isinstance(x, float) and math.isnan(x):
        return (2,)
    return (1, x)


class _Key:
    """Orders tuples of ranks by columns, each ascending or descending."""

    def __init__(self, values: tuple, down: list[bool]):
        self.v, self.down = tuple(map(_rank, values)), down

    def __lt__(self, other: _Key) -> bool:
        for a, b, d in zip(self.v, other.v, self.down, strict=True):
            if a != b:
                return (a < b) != d
        return False


def top_changes(df: DataFrame, order: list[tuple[str, bool]], n: int, arrival: str, partition: list[str] | None = None, state: DataFrame | None = None) -> DataFrame:
    """The changes that rows, in order of arrival, make to the first n by `order` (column, descending) of each partition:
    __op, __place, __seq (arrival) and __step. Ties rank after rows that were there; values order as they do in Spark, and
    pass through as Arrow holds them. state: rows that were in the top, with __place. A row below the first n of those that
    came before within its own task can change nothing and is dropped there first, so few rows reach the sequential part."""
    down, names = [d for _, d in order], df.columns
    fields = T.StructType([*df.schema.fields, T.StructField("__op", T.IntegerType()), T.StructField("__place", T.LongType()), T.StructField("__seq", T.LongType()), T.StructField("__step", T.IntegerType()), T.StructField("__final", T.BooleanType())])
    keys = list(partition or [])
    own, schema = list(keys), to_arrow_schema(fields)

    def ordered(b: pa.RecordBatch | pa.Table) -> list[_Key]:
        return [_Key(v, down) for v in zip(*(b.column(c).to_pylist() for c, _ in order), strict=True)]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple, list[_Key]] = {}
        for b in batches:
            keep = []
            for p, k in zip(zip(*(map(_rank, b.column(c).to_pylist()) for c in own), strict=True) if own else [()] * b.num_rows, ordered(b), strict=True):
                best = tops.setdefault(p, [])
                at = bisect_right(best, k)
                keep.append(at < n)
                if at < n:
                    best.insert(at, k)
                    del best[n:]
            yield b.filter(pa.array(keep, pa.bool_()))

    def fold(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        old, places, arrived, ranks = t.column("__old").to_pylist(), t.column("__place").to_pylist(), t.column(arrival).to_pylist(), ordered(t)
        best: list[tuple[_Key, int]] = []
        out: list[tuple] = []  # (row, op, place, seq, step, final)
        for i in sorted(range(t.num_rows), key=lambda i: (not old[i], places[i], arrived[i])):
            if old[i]:
                best.append((ranks[i], i))
                continue
            at = bisect_right([k for k, _ in best], ranks[i])
            if at >= n:
                continue
            before = [r for _, r in best]
            best.insert(at, (ranks[i], i))
            del best[n:]
            step = 0
            for place in range(at, len(best)):
                if place < len(before):
                    out.append((before[place], CORRECT_FROM, place + 1, arrived[i], step, False))
                    out.append((best[place][1], CORRECT_TO, place + 1, arrived[i], step + 1, False))
                else:
                    out.append((best[place][1], APPEND, place + 1, arrived[i], step, False))
                step += 2
        out += [(r, None, i + 1, None, None, True) for i, (_, r) in enumerate(best)]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        rows = t.select(names).take(pa.array(cols[0], pa.int64()))
        told = [pa.array(c, schema.field(len(names) + k).type) for k, c in enumerate(cols[1:])]
        return pa.Table.from_arrays([*rows.columns, *told], names=schema.names)

    fresh = df.sortWithinPartitions(arrival).mapInArrow(prune, df.schema).withColumn("__old", F.lit(False)).withColumn("__place", F.lit(0).cast("long"))
    rows = fresh if state is None else fresh.unionByName(state.select(*names, "__place").withColumn("__old", F.lit(True)))
    if not keys:
        rows, keys = rows.withColumn("__all", F.lit(True)), ["__all"]
    return rows.groupBy(*keys).applyInArrow(fold, fields)
