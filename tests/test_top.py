"""Changes of tops against a plain simulation."""

import math
import random

from pyspark.sql import functions as F

from tidewright.operators import top_changes


def simulated(rows, n, down):
    best, out = [], []
    low = lambda x: (0,) if x is None else (2,) if isinstance(x, float) and math.isnan(x) else (1, x)
    for seq, name, v in rows:
        at = sum(1 for _, _, w in best if low(w) == low(v) or (low(w) > low(v)) == down)
        if at >= n:
            continue
        was = list(best)
        best.insert(at, (seq, name, v))
        best = best[:n]
        for p in range(at, len(best)):
            out += [(2, p + 1, *was[p]), (3, p + 1, *best[p])] if p < len(was) else [(0, p + 1, *best[p])]
    return out


def test_values_pass_unchanged_and_order_as_in_spark(spark):
    rng = random.Random(4)
    big = 9007199254740993
    for kind, values in (("long", [None, big, big - 1, big + 1, 5, 5, -3]), ("double", [None, math.nan, math.inf, 1.5, 1.5, -0.0, 0.0]), ("string", [None, "", "a", "b", "é"]), ("decimal(30,2)", [None])):
        for down in (True, False):
            rows = [(i, f"n{i}", rng.choice(values)) for i in range(60)]
            df = spark.createDataFrame(rows, f"seq long, name string, v {kind}").repartition(3)
            found = [r for r in top_changes(df, [("v", down)], 4, "seq").collect() if not r["__final"]]
            got = [(r["__op"], r["__place"], r.seq, r.name, r.v) for r in sorted(found, key=lambda r: (r["__seq"], r["__step"]))]
            assert repr(got) == repr(simulated(rows, 4, down))
            order = F.desc_nulls_last("v") if down else F.asc_nulls_first("v")
            final = [(r.seq, repr(r.v)) for r in sorted(top_changes(df, [("v", down)], 4, "seq").where("__final").collect(), key=lambda r: r["__place"])]
            assert final == [(r.seq, repr(r.v)) for r in df.orderBy(order, "seq").limit(4).collect()]
