"""Bounded streams with a watermark for each event, and files in order. The rows, and what comes out of them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewright import dialect
from tidewright.model import Input, Vocab
from tidewright.operators import asof_join, drop_late, top_changes
from tidewright.sources.slices import read_slice


def ts(x):
    d = int(x)
    return datetime(2000, 1, 1) + timedelta(days=d - 1, hours=round((x - d) * 10))


def test_days_without_late_rows(spark):
    rows = [(1.1, 10, 20), (1.2, 11, 21), (2.1, 12, 21), (2.2, 13, 20), (1.3, 13, None), (3.1, 10, 19), (3.2, 9, 18), (1.4, 14, None)]
    ticks = [(ts(t), s, p) for t, a, b in rows for s, p in (("A", a), ("B", b)) if p is not None]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ticks)], "arr long, event_time timestamp, symbol string, price long")
    drop_late(df, "event_time", "arr", "1 day", "1 day").createOrReplaceTempView("ticks")
    out = spark.sql(dialect.translate("SELECT CAST(TUMBLE_START(event_time, INTERVAL '1' DAY) AS DATE) AS day, symbol, min(price) AS low, max(price) AS high FROM ticks GROUP BY TUMBLE(event_time, INTERVAL '1' DAY), symbol"))
    assert sorted((r.day.day, r.symbol, r.low, r.high) for r in out.collect()) == [(1, "A", 10, 13), (1, "B", 20, 21), (2, "A", 12, 13), (2, "B", 20, 21), (3, "A", 9, 10), (3, "B", 18, 19)]


def test_interval_join_keeps_repeated_rows(spark):
    spark.createDataFrame([(1, ts(1), 10), (2, ts(1), 120), (3, ts(5), 9), (4, ts(10), 110)], "id long, t timestamp, q long").createOrReplaceTempView("sold")
    spark.createDataFrame([(1, ts(1), 5), (1, ts(1), 5), (2, ts(2), 120), (3, ts(8), 9), (4, ts(11), 110)], "id long, t timestamp, n long").createOrReplaceTempView("sent")
    out = spark.sql(dialect.translate("SELECT sold.t AS t, sold.id AS id, q, sent.t AS at, n FROM sold LEFT JOIN sent ON sold.id = sent.id AND sent.t BETWEEN sold.t AND sold.t + INTERVAL '2' DAY"))
    want = [(ts(1), 1, 10, ts(1), 5)] * 2 + [(ts(1), 2, 120, ts(2), 120), (ts(5), 3, 9, None, None), (ts(10), 4, 110, ts(11), 110)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_prices_as_of_transactions(spark):
    prices = [(ts(i + 1), s, p) for s, all_ in (("A", (10, 11, 12, 15, 9, 13)), ("B", (120, 130, 110, 100, 110, 110))) for i, p in enumerate(all_)]
    moves = [(ts(1), "A", 100), (ts(2), "B", 100), (ts(5), "A", -100), (ts(5), "B", 100)]
    versions, left = spark.createDataFrame(prices, "t timestamp, symbol string, price int"), spark.createDataFrame(moves, "t timestamp, symbol string, volume int")
    got = [r.v for r in asof_join(left, versions, [("symbol", "symbol")], "t", "t", "p").orderBy("t", "symbol").select((-F.col("volume") * F.col("p.price")).alias("v")).collect()]
    assert got == [-1000, -13000, 900, -11000]


def test_top_of_scores(spark):
    scores = [(ts(1), "Alice", 100), (ts(1), "Bob", 80), (ts(2), "Alice", 70), (ts(2), "Charlie", 90), (ts(3), "Bob", 60), (ts(3), "Charlie", 110)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(scores)], "seq long, t timestamp, name string, score int")
    found = [r for r in top_changes(df, [("score", True)], 2, "seq").collect() if not r["__final"]]
    got = [(r["__op"], r["__place"], r.name, r.score, scores[r["__seq"]][0].day) for r in sorted(found, key=lambda r: (r["__seq"], r["__step"]))]
    assert got == [(0, 1, "Alice", 100, 1), (0, 2, "Bob", 80, 1), (2, 2, "Bob", 80, 2), (3, 2, "Charlie", 90, 2), (2, 1, "Alice", 100, 3), (3, 1, "Charlie", 110, 3), (2, 2, "Charlie", 90, 3), (3, 2, "Alice", 100, 3)]


def test_files_in_order_with_all_operations(spark, tmp_path):
    schema = "offset long, op int, system_time timestamp, event_time timestamp, symbol string, price int"
    rows = [(i, (0, 0, 2, 3, 1)[i % 5], ts(1), ts(1 + i), "AB"[i % 2], i) for i in range(15)]
    paths = []
    for k in range(3):
        paths.append(f"{tmp_path}/{k}")
        spark.createDataFrame(rows[5 * k : 5 * k + 5], schema).coalesce(1).write.parquet(paths[-1])
    got = read_slice(spark, Input("in", paths, paths[0], (0, 14), [], Vocab()))
    assert [tuple(r) for r in got.orderBy("offset").collect()] == rows and got.where("op in (2, 3)").count() == 6
    assert [r.offset for r in read_slice(spark, Input("in", paths, paths[0], (4, 6), [], Vocab())).orderBy("offset").collect()] == [4, 5, 6]
    assert read_slice(spark, Input("in", [], paths[0], None, [], Vocab())).count() == 0
