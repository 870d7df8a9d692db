"""Runs of several slices with explicit watermarks, as a dataset coordinator makes them.

Fixed values, which results must equal: the names of system columns and of inputs, the rows and watermarks of the slices of
the first tests, and what comes out of them.
"""

from datetime import datetime, timedelta

import pytest

from tidewright import dialect
from tidewright.model import Failure, Input, Step, Transform, TransformRequest, Vocab
from tidewright.plans import execute_transform

SYS = datetime(2020, 1, 1)


def ts(x):
    d = int(x)
    return datetime(2000, 1, 1) + timedelta(days=d - 1, hours=round((x - d) * 10))


class Dataset:
    """Runs slices one after another. tables: name -> fields behind the system columns."""

    def __init__(self, spark, tmp, steps, schemas, temporal=None, vocab=None):
        self.spark, self.tmp, self.schemas = spark, tmp, schemas
        self.transform = Transform([Step(q, a) for a, q in steps], "flink", temporal or {})
        self.vocab, self.prev, self.run, self.at, self.last = vocab or Vocab(), None, 0, {}, {}

    def slice(self, data, marks, offset):
        self.run += 1
        inputs = []
        for name, schema in self.schemas.items():
            rows, start = data.get(name), self.at.get(name, 0)
            if rows:
                path = f"{self.tmp}/in{self.run}-{name}"
                full = [(start + i, r[0] if isinstance(r[0], int) and "OP" in schema else 0, SYS, *(r[1:] if "OP" in schema else r)) for i, r in enumerate(rows)]
                full = [tuple(ts(x) if j == 3 else x for j, x in enumerate(r)) for r in full]
                self.spark.createDataFrame(full, f"offset long, op int, system_time timestamp, {schema.replace('OP ', '')}").coalesce(1).write.parquet(path)
                self.last[name], self.at[name] = path, start + len(rows)
            inputs.append(Input(name, [self.last[name]] if rows else [], self.last[name], (start, start + len(rows) - 1) if rows else None, [ts(marks[name])] if name in marks else [], Vocab(event_time=schema.replace("OP ", "").split()[0])))
        request = TransformRequest(self.transform, inputs, SYS, offset, f"{self.tmp}/out{self.run}.parquet", f"{self.tmp}/state{self.run}", self.prev, self.vocab)
        response = execute_transform(self.spark, request)
        if isinstance(response, Failure):
            print(response.message, response.backtrace)
            return response, None
        self.prev = request.checkpoint
        try:
            out = self.spark.read.parquet(request.data_path)
            rows = [tuple(r) for r in out.orderBy(self.vocab.offset).collect()]
            assert [r[0] for r in rows] == list(range(response.interval[0], response.interval[1] + 1))
            assert out.columns[:3] == ["offset", "op", "system_time"] and {r[2] for r in rows} == {SYS}
            return response, [r[1:2] + r[3:] for r in rows]
        except Exception:
            assert response.interval is None
            return response, []


TICKER = "event_time timestamp, symbol string, price int"
DAILY = "SELECT TUMBLE_START(event_time, INTERVAL '1' DAY) AS event_time, symbol, MIN(price) AS low, MAX(price) AS high FROM `in` GROUP BY symbol, TUMBLE(event_time, INTERVAL '1' DAY)"


DAILY_TABLE = "SELECT window_start AS event_time, symbol, MIN(price) AS low, MAX(price) AS high FROM TABLE(TUMBLE(TABLE `in`, DESCRIPTOR(event_time), INTERVAL '1' DAY)) GROUP BY window_start, window_end, symbol"


@pytest.mark.parametrize("query", [DAILY, DAILY_TABLE])
def test_windows_over_slices(spark, tmp_path, query):
    d = Dataset(spark, tmp_path, [(None, query)], {"in": TICKER})
    r, out = d.slice({"in": [(t, s, p) for t, p in ((1.1, 10), (1.2, 11), (2.1, 12), (2.2, 13), (3.1, 14), (3.2, 15)) for s, p in (("A", p), ("B", p + 10))]}, {"in": 3.2}, 0)
    assert sorted(out) == [(0, ts(1), "A", 10, 11), (0, ts(1), "B", 20, 21), (0, ts(2), "A", 12, 13), (0, ts(2), "B", 22, 23)]
    assert r.interval == (0, 3) and r.watermark == ts(3.2)
    r, out = d.slice({"in": [(4.1, "A", 16), (5.1, "A", 18)]}, {"in": 5.2}, 4)
    assert sorted(out) == [(0, ts(3), "A", 14, 15), (0, ts(3), "B", 24, 25), (0, ts(4), "A", 16, 16)]
    r, out = d.slice({}, {"in": 7.1}, 7)
    assert out == [(0, ts(5), "A", 18, 18)] and r.watermark == ts(7.1)
    r, out = d.slice({}, {"in": 8}, 8)
    assert out == [] and r.interval is None and r.watermark == ts(8)


def test_late_rows(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, DAILY)], {"in": TICKER})
    _, out = d.slice({"in": [(1.1, "A", 10), (2.1, "A", 12), (1.3, "A", 11), (3.1, "A", 14)]}, {"in": 2.2}, 0)
    assert out == [(0, ts(1), "A", 10, 11)]
    _, out = d.slice({"in": [(1.4, "A", 12), (4.1, "A", 16)]}, {"in": 4.1}, 1)
    assert out == [(0, ts(2), "A", 12, 12), (0, ts(3), "A", 14, 14)]


JOIN = """SELECT sold.event_time AS order_time, sold.order_id, sold.quantity AS wanted, CAST(sent.event_time AS TIMESTAMP(3)) AS sent_at, COALESCE(sent.num_shipped, 0) AS sent_now
FROM orders AS sold LEFT JOIN shipments AS sent ON sold.order_id = sent.order_id AND sent.event_time BETWEEN sold.event_time AND sold.event_time + INTERVAL '2' DAY"""
ORDERS = {"orders": "event_time timestamp, order_id long, quantity long", "shipments": "event_time timestamp, order_id long, num_shipped long"}


def test_interval_join(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, JOIN)], ORDERS, vocab=Vocab(event_time="order_time"))
    _, out = d.slice({"orders": [(1, 1, 10), (1, 2, 120), (5, 3, 9)], "shipments": [(1, 1, 4), (2, 1, 6), (2, 2, 120)]}, {"orders": 5, "shipments": 2}, 0)
    assert sorted(out) == [(0, ts(1), 1, 10, ts(1), 4), (0, ts(1), 1, 10, ts(2), 6), (0, ts(1), 2, 120, ts(2), 120)]
    r, out = d.slice({"orders": [(10, 4, 110)], "shipments": [(8, 3, 9), (11, 4, 110)]}, {"orders": 10, "shipments": 11}, 3)
    assert sorted(out) == [(0, ts(5), 3, 9, None, 0), (0, ts(10), 4, 110, ts(11), 110)] and r.watermark == ts(8)


def test_full_interval_join(spark, tmp_path):
    q = JOIN.replace("LEFT JOIN", "FULL OUTER JOIN").replace("sold.event_time AS order_time", "COALESCE(sold.event_time, sent.event_time) AS order_time")
    d = Dataset(spark, tmp_path, [(None, q)], ORDERS, vocab=Vocab(event_time="order_time"))
    _, out = d.slice({"orders": [(1, 1, 10), (5, 3, 9)], "shipments": [(1, 1, 4), (2, 7, 6), (9, 3, 1)]}, {"orders": 5, "shipments": 2}, 0)
    assert sorted(out, key=repr) == [(0, ts(1), 1, 10, ts(1), 4)]
    _, out = d.slice({"shipments": [(6, 3, 2)]}, {"orders": 9, "shipments": 6}, 1)
    assert sorted(out, key=repr) == [(0, ts(2), None, None, ts(2), 6), (0, ts(5), 3, 9, ts(6), 2)]
    _, out = d.slice({}, {"orders": 20, "shipments": 20}, 3)
    assert out == [(0, ts(9), None, None, ts(9), 1)]
    d = Dataset(spark, tmp_path / "r", [(None, q.replace("FULL OUTER", "RIGHT"))], ORDERS, vocab=Vocab(event_time="order_time"))
    _, out = d.slice({"orders": [(1, 1, 10)], "shipments": [(2, 7, 6)]}, {"orders": 9, "shipments": 9}, 0)
    assert out == [(0, ts(2), None, None, ts(2), 6)]


HOPS = "SELECT HOP_START(event_time, INTERVAL '1' DAY, INTERVAL '2' DAY) as event_time, symbol, sum(price) as total FROM `in` GROUP BY HOP(event_time, INTERVAL '1' DAY, INTERVAL '2' DAY), symbol"


def test_hopping_windows_over_slices(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, HOPS)], {"in": TICKER})
    _, out = d.slice({"in": [(2.1, "A", 1), (3.1, "A", 10), (4.1, "A", 100)]}, {"in": 4.1}, 0)
    assert sorted(out) == [(0, ts(1), "A", 1), (0, ts(2), "A", 11)]
    r, out = d.slice({"in": [(3.2, "A", 1000)]}, {"in": 5}, 2)  # late for the window of the days 2 and 3 only
    assert out == [(0, ts(3), "A", 1110)] and r.watermark == ts(5)
    _, out = d.slice({"in": [(3.3, "A", 5)]}, {"in": 9}, 3)  # late for all its windows
    assert out == [(0, ts(4), "A", 100)]


SESSIONS = "SELECT SESSION_START(event_time, INTERVAL '12' HOUR) as event_time, i.symbol, count(*) as n, sum(price) as total FROM `in` AS i GROUP BY SESSION(event_time, INTERVAL '12' HOUR), i.symbol"


def test_sessions_over_slices(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, SESSIONS)], {"in": TICKER})
    _, out = d.slice({"in": [(1, "A", 1), (1.3, "A", 10), (1.1, "B", 5), (2.4, "A", 100)]}, {"in": 2}, 0)
    assert sorted(out) == [(0, ts(1), "A", 2, 11), (0, ts(1.1), "B", 1, 5)]
    _, out = d.slice({"in": [(2.8, "A", 1000), (1.2, "B", 7)]}, {"in": 2.9}, 2)  # the row of B is late
    assert out == []
    r, out = d.slice({}, {"in": 5}, 2)
    assert sorted(out) == [(0, ts(2.4), "A", 2, 1100)] and r.watermark == ts(5)


@pytest.mark.parametrize("gap", [12 * 3600, 12 * 3600 + 1])
def test_sessions_agree_with_bounded_queries(spark, tmp_path, gap):
    rows = [(ts(1), "A", 1), (ts(1) + timedelta(seconds=gap), "A", 10)]
    spark.createDataFrame(rows, TICKER).createOrReplaceTempView("in")
    want = spark.sql(dialect.translate(SESSIONS)).count()
    d = Dataset(spark, tmp_path, [(None, SESSIONS)], {"in": TICKER})
    d.spark.createDataFrame([(i, 0, SYS, *r) for i, r in enumerate(rows)], "offset long, op int, system_time timestamp, " + TICKER).coalesce(1).write.parquet(f"{tmp_path}/x")
    path = f"{tmp_path}/x"
    request = TransformRequest(d.transform, [Input("in", [path], path, (0, 1), [ts(9)], Vocab(event_time="event_time"))], SYS, 0, f"{tmp_path}/o.parquet", f"{tmp_path}/s", None, Vocab())
    assert execute_transform(spark, request).interval == (0, want - 1)


def test_current_watermark(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, "SELECT event_time, CURRENT_WATERMARK(event_time) as wm FROM `in`")], {"in": TICKER})
    assert d.slice({"in": [(1, "A", 1)]}, {"in": 2}, 0)[1] == [(0, ts(1), None)]
    assert d.slice({"in": [(3, "A", 1)]}, {"in": 4}, 1)[1] == [(0, ts(3), ts(2))]


def test_chain(spark, tmp_path):
    stats = "SELECT TUMBLE_START(order_time, INTERVAL '1' DAY) AS order_time, order_id, COUNT(*) AS parts, MIN(sent_at) AS first_sent, MAX(sent_at) AS last_sent, MIN(wanted) AS wanted, SUM(sent_now) AS sent_in_all FROM joined GROUP BY order_id, TUMBLE(order_time, INTERVAL '1' DAY)"
    last = "SELECT * FROM totals WHERE sent_in_all <> wanted"
    d = Dataset(spark, tmp_path, [("joined", JOIN), ("totals", stats), (None, last)], ORDERS, vocab=Vocab(event_time="order_time"))
    r, out = d.slice({"orders": [(1, 1, 10), (1, 2, 120), (5, 3, 9), (10, 4, 110)], "shipments": [(1, 1, 4), (2, 1, 6), (2, 2, 120), (8, 3, 9), (11, 4, 50), (13, 4, 60)]}, {"orders": 13, "shipments": 13}, 0)
    assert out == [(0, ts(5), 3, 1, None, None, 9, 0), (0, ts(10), 4, 1, ts(11), ts(11), 110, 50)] and r.watermark == ts(11)


@pytest.mark.parametrize("syntax", ["FROM tickers as t, LATERAL TABLE (`stocks.owned`(t.event_time)) AS owned WHERE t.symbol = owned.symbol", "FROM `tickers` as t JOIN `stocks.owned` FOR SYSTEM_TIME AS OF t.event_time as owned ON t.symbol = owned.symbol"])
def test_temporal_join(spark, tmp_path, syntax):
    q = f"SELECT t.event_time, t.symbol, owned.volume as volume, t.price as current_price, owned.volume * t.price as current_value {syntax}"
    d = Dataset(spark, tmp_path, [(None, q)], {"tickers": TICKER, "stocks.owned": "event_time timestamp, symbol string, volume int"}, {"stocks.owned": ["symbol"]})
    r, out = d.slice({"tickers": [(1, "A", 10), (1, "B", 20), (2, "A", 10), (2, "B", 20), (3, "A", 12), (3, "B", 22), (4, "A", 14), (4, "B", 24)], "stocks.owned": [(2, "A", 100), (3, "B", 200)]}, {"tickers": 4, "stocks.owned": 3}, 0)
    assert out == [(0, ts(2), "A", 100, 10, 1000), (0, ts(3), "A", 100, 12, 1200), (0, ts(3), "B", 200, 22, 4400)] and r.watermark == ts(3)
    r, out = d.slice({"tickers": [(5, "A", 15), (5, "B", 25)], "stocks.owned": [(4, "B", 250)]}, {"tickers": 5, "stocks.owned": 4}, 3)
    assert out == [(0, ts(4), "A", 100, 14, 1400), (0, ts(4), "B", 250, 24, 6000)] and r.watermark == ts(4)


def test_versions_ahead_of_probes(spark, tmp_path):
    q = "SELECT x.event_time, x.symbol, y.volume, x.price, x.price * y.volume AS worth FROM tickers AS x, LATERAL TABLE (`stocks.owned`(x.event_time)) AS y WHERE x.symbol = y.symbol"
    d = Dataset(spark, tmp_path, [(None, q)], {"tickers": TICKER, "stocks.owned": "event_time timestamp, symbol string, volume int"}, {"stocks.owned": ["symbol"]})
    r, out = d.slice({"tickers": [(i, "A", i) for i in range(1, 6)], "stocks.owned": [(3, "A", 100)]}, {"tickers": 5, "stocks.owned": 5}, 0)
    assert out == [(0, ts(i), "A", 100, i, 100 * i) for i in (3, 4, 5)] and r.interval == (0, 2) and r.watermark == ts(5)


def test_composite_and_missing_keys(spark, tmp_path):
    q = "SELECT x.event_time, x.symbol, y.volume FROM tickers AS x JOIN `owned` FOR SYSTEM_TIME AS OF x.event_time AS y ON x.symbol = y.symbol AND x.price = y.lot"
    tables = {"tickers": TICKER, "owned": "event_time timestamp, symbol string, lot int, volume int"}
    d = Dataset(spark, tmp_path, [(None, q)], tables, {"owned": ["symbol", "lot"]})
    _, out = d.slice({"tickers": [(2, "A", 1), (2, "A", 2), (2, "B", 1)], "owned": [(1, "A", 1, 10), (1, "A", 2, 20), (2, "A", 2, 21), (3, "B", 1, 5)]}, {"tickers": 3, "owned": 3}, 0)
    assert sorted(out) == [(0, ts(2), "A", 10), (0, ts(2), "A", 21)]
    for n, (keys, kind) in enumerate((([], "InternalError"), (["none"], "InvalidQuery"))):
        assert Dataset(spark, tmp_path / str(n), [(None, q)], tables, {"owned": keys}).slice({"tickers": [(1, "A", 1)], "owned": [(1, "A", 1, 1)]}, {}, 0)[0].kind == kind


def test_map_and_corrections(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, "SELECT event_time, symbol, price * 10 as price FROM `in`")], {"in": TICKER})
    _, out = d.slice({"in": [(1, "A", 10), (2, "B", 20), (3, "A", 11)]}, {"in": 4}, 0)
    assert out == [(0, ts(1), "A", 100), (0, ts(2), "B", 200), (0, ts(3), "A", 110)]
    d = Dataset(spark, tmp_path / "b", [(None, "SELECT op, event_time, symbol, price * 10 as price FROM `in`")], {"in": "OP " + TICKER})
    r, out = d.slice({"in": [(0, 1, "A", 10), (2, 1, "A", 10), (3, 1, "A", 11), (1, 1, "A", 11)]}, {"in": 1}, 0)
    assert out == [(0, ts(1), "A", 100), (2, ts(1), "A", 100), (3, ts(1), "A", 110), (1, ts(1), "A", 110)]


def test_top(spark, tmp_path):
    q = "select cast(now() as timestamp(3)) as placed_at, * from (select row_number() over (order by score desc) AS place, match_time, player_name, score from match_scores) where place <= 2"
    d = Dataset(spark, tmp_path, [(None, q)], {"match_scores": "match_time timestamp, player_name string, score int"}, vocab=Vocab(event_time="placed_at"))
    r, out = d.slice({"match_scores": [(1, "Alice", 100), (1, "Bob", 80), (2, "Alice", 70), (2, "Charlie", 90), (3, "Bob", 60)]}, {"match_scores": 2}, 0)
    first = [(o, p, t, n, s) for o, _, p, t, n, s in out]
    r, out = d.slice({"match_scores": [(3, "Charlie", 110)]}, {"match_scores": 3}, 4)
    got = first + [(o, p, t, n, s) for o, _, p, t, n, s in out]
    assert got == [(0, 1, ts(1), "Alice", 100), (0, 2, ts(1), "Bob", 80), (2, 2, ts(1), "Bob", 80), (3, 2, ts(2), "Charlie", 90), (2, 1, ts(1), "Alice", 100), (3, 1, ts(3), "Charlie", 110), (2, 2, ts(2), "Charlie", 90), (3, 2, ts(1), "Alice", 100)]
    assert r.interval == (4, 7) and r.watermark == ts(3)


def test_refusals(spark, tmp_path):
    def of(q, **k):
        return Dataset(spark, tmp_path / str(abs(hash(q))), [(None, q)], {"in": TICKER}, **k).slice({"in": [(1, "A", 1)]}, {"in": 1}, 0)[0]

    assert "conflicts with the system column" in of("SELECT * FROM `in`").message
    assert "was not found among: x" in of("SELECT price as x FROM `in`").message
    assert of("SELECT nothing FROM `in`").kind == "InvalidQuery"
    assert "two steps" in of("SELECT TUMBLE_START(a.event_time, INTERVAL '1' DAY) as event_time, count(*) as n FROM `in` AS a JOIN `in` AS b ON a.symbol = b.symbol GROUP BY TUMBLE(a.event_time, INTERVAL '1' DAY)").message
    assert of("SELECT event_time, nothing FROM `in` ORDER BY event_time LIMIT 1").kind == "InvalidQuery"


def test_running_aggregates(spark, tmp_path):
    q = "SELECT max(i.event_time) AS event_time, i.symbol, count(*) AS n, sum(price) AS total, avg(price) AS mean, min(price) AS least FROM `in` AS i WHERE price > 0 GROUP BY i.symbol"
    d = Dataset(spark, tmp_path, [(None, q)], {"in": TICKER})
    _, out = d.slice({"in": [(1, "A", 10), (1, "B", 5), (2, "A", 4), (2, "A", -1), (2, None, 1)]}, {"in": 2}, 0)
    assert out == [(0, ts(1), "A", 1, 10, 10.0, 10), (0, ts(1), "B", 1, 5, 5.0, 5), (2, ts(1), "A", 1, 10, 10.0, 10), (3, ts(2), "A", 2, 14, 7.0, 4), (0, ts(2), None, 1, 1, 1.0, 1)]
    r, out = d.slice({"in": [(3, "A", 1), (3, None, None), (3, "C", 2)]}, {"in": 3}, 5)
    assert out == [(2, ts(2), "A", 2, 14, 7.0, 4), (3, ts(3), "A", 3, 15, 5.0, 1), (0, ts(3), "C", 1, 2, 2.0, 2)] and r.watermark == ts(3)
    _, out = d.slice({"in": [(4, "B", 7)]}, {"in": 4}, 8)
    assert out == [(2, ts(1), "B", 1, 5, 5.0, 5), (3, ts(4), "B", 2, 12, 6.0, 5)]


def test_distinct(spark, tmp_path):
    d = Dataset(spark, tmp_path, [(None, "SELECT DISTINCT event_time, symbol FROM `in`")], {"in": TICKER})
    assert d.slice({"in": [(1, "A", 1), (1, "A", 2), (2, "B", 1)]}, {"in": 2}, 0)[1] == [(0, ts(1), "A"), (0, ts(2), "B")]
    assert d.slice({"in": [(1, "A", 3), (2, "A", 4)]}, {"in": 3}, 2)[1] == [(0, ts(2), "A")]


def test_dialect_keeps_literals_and_names():
    assert dialect.translate("SELECT 'a[1] FETCH FIRST 2 ROWS ONLY', `x[1]`, t.m['k'] FROM t") == "SELECT 'a[1] FETCH FIRST 2 ROWS ONLY', `x[1]`, try_element_at(t.m, 'k') FROM t"
    assert dialect.translate("SELECT a[1][2] FROM t FETCH FIRST ROW ONLY") == "SELECT try_element_at(try_element_at(a, 1), 2) FROM t LIMIT 1"
    assert dialect.translate("SELECT a FROM t OFFSET 3 ROWS") == "SELECT a FROM t OFFSET 3"
    assert dialect.translate("SELECT offset, fetch FROM t") == "SELECT offset, fetch FROM t"
    assert dialect.shape("SELECT window_start, k, count(*) AS n FROM TABLE(HOP(TABLE t, DESCRIPTOR(c), INTERVAL '1' DAY, INTERVAL '2' DAY)) GROUP BY window_start, window_end, k", {}).kind == "window"
    for bad in ("SELECT (f(a))[1] FROM t", "SELECT * FROM TABLE(TUMBLE(TABLE t, INTERVAL '1' DAY))"):
        with pytest.raises(dialect.InvalidQueryError):
            dialect.translate(bad)


def test_json_query_and_collect(spark):
    sql = "SELECT COLLECT(JSON_QUERY(j, '$.a')) AS a, COLLECT(JSON_QUERY(j, '$.b')) AS b FROM (VALUES ('{\"a\": [1, 2], \"b\": 3}'), ('no json'), (NULL)) AS t (j)"
    assert tuple(spark.sql(dialect.translate(sql)).first()) == (["[1,2]"], [])


def stands(changes):
    """The rows that stand after changes (op, row…)."""
    left = []
    for op, *row in changes:
        if op in (0, 3):
            left.append(tuple(row))
        else:
            left.remove(tuple(row))
    return sorted(left, key=repr)


#: Queries over two streams, of shapes that need all rows so far.
WHOLE = {
    "in": "SELECT event_time, symbol, price FROM a WHERE symbol IN (SELECT symbol FROM b)",
    "not exists": "SELECT event_time, symbol FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol)",
    "join": "SELECT a.event_time, a.symbol, a.price + b.price AS price FROM a JOIN b ON a.symbol = b.symbol",
    "left join": "SELECT a.event_time, a.symbol, b.price FROM a LEFT JOIN b ON a.symbol = b.symbol AND b.price > 5",
    "comma": "SELECT a.event_time, b.price FROM a, b WHERE a.price < b.price",
    "limit": "SELECT event_time, symbol, price FROM a ORDER BY price DESC, symbol LIMIT 2",
    "over": "SELECT event_time, symbol, sum(price) OVER (PARTITION BY symbol ORDER BY event_time, price) AS total FROM a",
    "having": "SELECT max(event_time) AS event_time, symbol, stddev(price) AS s, count(DISTINCT price) AS n FROM a GROUP BY symbol HAVING count(*) > 1",
    "global": "SELECT max(event_time) AS event_time, count(*) AS n FROM a",
    "computed key": "SELECT max(event_time) AS event_time, price % 2 AS k, sum(price) AS total FROM a GROUP BY price % 2",
    "union": "SELECT event_time, symbol FROM a UNION SELECT event_time, symbol FROM b",
    "except": "SELECT event_time, symbol FROM a EXCEPT SELECT event_time, symbol FROM b",
    "scalar": "SELECT event_time, price - (SELECT min(price) FROM b) AS over FROM a",
    "union all": "SELECT event_time, symbol, price FROM a WHERE price > 1 UNION ALL SELECT event_time, 'b', price * 2 FROM b",
    "derived": "SELECT event_time, p FROM (SELECT event_time, price * 2 AS p FROM a WHERE price > 1) WHERE p < 20",
}
FILLED = {"a": [[(1, "A", 1), (1.2, "B", 7), (1.2, "A", 2)], [(2, "C", 9), (2, "A", 2)], [(3, "B", 1), (3, "D", 30)]], "b": [[(1, "B", 3)], [(2, "A", 10), (2, "B", 4), (2, "Z", 1)], [(1.2, "A", 6)]]}


@pytest.mark.parametrize("shape", WHOLE)
def test_any_query_over_slices(spark, tmp_path, shape):
    d = Dataset(spark, tmp_path, [(None, WHOLE[shape])], {"a": TICKER, "b": TICKER})
    changes, at = [], 0
    for k in range(3):
        r, out = d.slice({n: x[k] for n, x in FILLED.items()}, {"a": k + 1, "b": k + 1}, at)
        changes += out
        at += len(out)
        for n, x in FILLED.items():
            spark.createDataFrame([(ts(t), s, p) for part in x[: k + 1] for t, s, p in part], TICKER).createOrReplaceTempView(n)
        assert stands(changes) == sorted(map(tuple, spark.sql(WHOLE[shape]).collect()), key=repr)
        assert r.watermark == ts(k + 1)


def test_steps_after_changelogs(spark, tmp_path):
    rows = [[(1, "A", 1), (1.1, "A", 2), (1.1, "B", 5)], [(2, "A", 3), (2, "B", 1)], [(5, "C", 0)]]
    running = ("sums", "SELECT max(event_time) AS event_time, symbol, sum(price) AS total FROM `in` GROUP BY symbol")

    def run(name, query, marks=(1, 2, 5)):
        d = Dataset(spark, tmp_path / name, [running, (None, query)], {"in": TICKER})
        out, at = [], 0
        for x, m in zip(rows, marks, strict=True):
            out += d.slice({"in": x}, {"in": m}, at)[1] or []
            at = len(out)
        return out

    assert [x[0] for x in run("filter", "SELECT event_time, symbol, total FROM sums WHERE symbol = 'A'")] == [0, 2, 3, 2, 3]
    assert stands(run("map", "SELECT event_time, symbol, total * 2 AS total FROM sums")) == [(ts(2), "A", 12), (ts(2), "B", 12), (ts(5), "C", 0)]
    assert stands(run("group", "SELECT max(event_time) AS event_time, sum(total) AS total, count(*) AS n FROM sums GROUP BY total > 100")) == [(ts(5), 12, 3)]
    windows = run("window", "SELECT TUMBLE_START(event_time, INTERVAL '1' DAY) AS event_time, sum(total) AS total FROM sums GROUP BY TUMBLE(event_time, INTERVAL '1' DAY)")
    assert windows == [(0, ts(2), 12)]  # before its day closed, all sums of the first day were taken back
    top = Dataset(spark, tmp_path / "top", [running, (None, "SELECT event_time, symbol FROM (SELECT event_time, symbol, ROW_NUMBER() OVER (ORDER BY total DESC) AS p FROM sums) WHERE p <= 1")], {"in": TICKER})
    assert "changelog" in top.slice({"in": rows[0]}, {"in": 1}, 0)[0].message


def test_counts_and_debugging(spark, tmp_path, caplog):
    from tidewright.sinks import load_json

    d = Dataset(spark, tmp_path, [(None, "SELECT event_time, symbol FROM `in` WHERE price > 1")], {"in": TICKER})
    d.slice({"in": [(1, "A", 1), (1, "B", 2)]}, {"in": 1}, 0)
    with caplog.at_level("DEBUG", logger="tidewright"):
        d.slice({"in": [(2, "C", 3)]}, {"in": 2}, 1)
    state = load_json(spark, f"{d.prev}/_state")
    assert (state["rows/input/in"], state["rows/output"]) == ("3", "2")
    assert any("C" in x.getMessage() for x in caplog.records) and any("watermark 2000-01-02" in x.getMessage() for x in caplog.records)
