"""Operators against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewright.operators import asof_join, with_offsets

START = datetime(2000, 1, 1)


def test_asof_join_by_buckets(spark):
    rng = random.Random(1)
    moment = lambda: START + timedelta(seconds=rng.randrange(5000))
    versions = [(i, rng.choice("AB"), moment(), i * 10) for i in range(60)]
    versions += [(100 + i, k, t, -i) for i, (_, k, t, _) in enumerate(versions[:10])]  # equal times: the later one counts
    probes = [(i, rng.choice(["A", "B", "C", None]), moment()) for i in range(200)] + [(500, "A", versions[0][2]), (501, "A", START + timedelta(days=9)), (502, "B", None)]
    left, right = spark.createDataFrame(probes, "id long, k string, t timestamp"), spark.createDataFrame(versions, "seq long, k string, at timestamp, v long")
    want = {}
    for i, k, t in probes:
        known = [x for x in versions if t is not None and x[1] == k and x[2] <= t]
        want[i] = max(known, key=lambda x: (x[2], x[0]))[3] if known else None
    for bucket in (None, 1, 100, 100_000):
        got = {r.id: r.v for r in asof_join(left, right, [("k", "k")], "t", "at", "x", "seq", True, bucket).select("id", F.col("x.v").alias("v")).collect()}
        assert got == want
        assert asof_join(left, right, [("k", "k")], "t", "at", "x", "seq", False, bucket).count() == sum(v is not None for v in want.values())


def test_offsets_are_consecutive_and_in_order(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    numbered, n = with_offsets(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.col("a"), F.col("b")], 40)
    got = [(r.offset, r.a, r.b) for r in numbered.coalesce(1).collect()]
    assert n == 500 and got == [(40 + i, *r) for i, r in enumerate(sorted(rows))]
    assert with_offsets(spark.createDataFrame([], "a int"), [F.col("a")], 3)[1] == 0
