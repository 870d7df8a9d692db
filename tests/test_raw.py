"""Raw queries, requests by files, and Parquet types."""

import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml

from tidewright import cli
from tidewright.model import Failure, Input, RawQueryRequest, Step, Transform, Vocab
from tidewright.plans import execute_raw_query
from tidewright.sources.slices import read_slice

SYS = dt.datetime(2020, 1, 1)


def day(n):
    return dt.datetime(2000, 1, n)


def raw(spark, tmp, rows, schema, steps, temporal=None):
    path = f"{tmp}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    steps = [Step(steps)] if isinstance(steps, str) else steps
    got = execute_raw_query(spark, RawQueryRequest([path], Transform(steps, "flink", temporal or {}), f"{tmp}/out.parquet"))
    return got if isinstance(got, Failure) or not got.num_records else [tuple(r) for r in spark.read.parquet(f"{tmp}/out.parquet").collect()]


def test_system_columns_pass_and_none_are_added(spark, tmp_path):
    rows = [(i, 0, SYS, day(i + 1), "AB"[i % 2], 10 + i) for i in range(4)]
    got = raw(spark, tmp_path, rows, "offset long, op int, system_time timestamp, event_time timestamp, symbol string, price int", "SELECT offset, op, system_time, event_time, symbol, price * 10 AS price FROM input")
    assert sorted(got) == [(*r[:5], r[5] * 10) for r in rows]


def test_casts_to_decimals(spark, tmp_path):
    small, large = "123456789.0123", "12345678901234567890.123456789012345678"
    rows = [(x,) for x in (small, f"-{small}", large, f"-{large}")]
    got = raw(spark, tmp_path, rows, "value string", "SELECT TRY_CAST(value AS DECIMAL(13, 4)) AS a, TRY_CAST(value AS DECIMAL(38, 18)) AS b FROM input")
    assert got == [(Decimal(v) if len(v) < 20 else None, Decimal(v)) for (v,) in rows]
    assert raw(spark, tmp_path / "s", [(Decimal(small),)], "decimal decimal(20,4)", "SELECT CAST(`decimal` AS STRING) AS value FROM input") == [(small,)]


def test_steps_empty_results_and_failures(spark, tmp_path):
    steps = [Step("SELECT x + 1 AS x FROM input", "more"), Step("SELECT x FROM more WHERE x > 2")]
    assert sorted(raw(spark, tmp_path, [(1,), (2,), (3,)], "x int", steps)) == [(3,), (4,)]
    none = raw(spark, tmp_path / "n", [(1,)], "x int", "SELECT x FROM input WHERE x > 9")
    assert none.num_records == 0 and not (tmp_path / "n" / "out.parquet").exists()
    assert raw(spark, tmp_path / "f", [(1,)], "x int", "SELECT y FROM input").kind == "InvalidQuery"
    assert raw(spark, tmp_path / "g", [(1,)], "x int", "SELEC").kind == "InvalidQuery"


def test_temporal_join(spark, tmp_path):
    rows = [(i, kind, day(d), s, n) for i, (kind, d, s, n) in enumerate((("t", 1, "A", 10), ("p", 2, "A", 100), ("t", 2, "A", 11), ("p", 3, "B", 200), ("t", 3, "B", 22), ("t", 4, "A", 14)))]
    split = [Step("SELECT event_time, symbol, n AS price FROM input WHERE kind = 't'", "tickers"), Step("SELECT offset, event_time, symbol, n AS volume FROM input WHERE kind = 'p'", "owned")]
    want = [(day(2), "A", 1100), (day(3), "B", 4400), (day(4), "A", 1400)]
    for k, join in enumerate(("FROM tickers AS t, LATERAL TABLE (owned(t.event_time)) AS o WHERE t.symbol = o.symbol", "FROM tickers AS t JOIN owned FOR SYSTEM_TIME AS OF t.event_time AS o ON t.symbol = o.symbol")):
        query = f"SELECT t.event_time, t.symbol, o.volume * t.price AS worth {join}"
        assert sorted(raw(spark, tmp_path / str(k), rows, "offset long, kind string, event_time timestamp, symbol string, n int", [*split, Step(query)], {"owned": ["symbol"]})) == want


def test_snapshot_at_a_constant_time(spark, tmp_path):
    rows = [(0, day(1), "A", 1), (1, day(2), "A", 2), (2, day(2), "B", 3), (3, day(4), "A", 4)]
    query = "SELECT p.symbol, p.price FROM input FOR SYSTEM_TIME AS OF TIMESTAMP '2000-01-03 00:00:00' AS p"
    schema = "offset long, event_time timestamp, symbol string, price int"
    assert sorted(raw(spark, tmp_path, rows, schema, query, {"input": ["symbol"]})) == [("A", 2), ("B", 3)]
    assert "primary key" in raw(spark, tmp_path / "n", rows, schema, query).message


def test_checkpoints_as_tar_files(spark, tmp_path):
    types = {"offset": pa.int64(), "op": pa.int32(), "system_time": pa.timestamp("ms", "UTC"), "event_time": pa.timestamp("ms", "UTC"), "price": pa.int32()}
    totals = []
    for k in range(2):
        values = {"offset": [k], "op": [0], "system_time": [SYS], "event_time": [day(k + 1)], "price": [10 + k]}
        pq.write_table(pa.table({c: pa.array(v, types[c]) for c, v in values.items()}), f"{tmp_path}/{k}.parquet")
        request = {
            "transform": {"engine": "flink", "query": "SELECT max(event_time) AS event_time, 'x' AS k, sum(price) AS total FROM `in` GROUP BY 'x'"},
            "queryInputs": [{"queryAlias": "in", "dataPaths": [f"{tmp_path}/{k}.parquet"], "offsetInterval": {"start": k, "end": k}, "explicitWatermarks": []}],
            "systemTime": "2020-01-01T00:00:00Z", "nextOffset": 2 * k, "newDataPath": f"{tmp_path}/new{k}.parquet", "newCheckpointPath": f"{tmp_path}/state{k}.tar", "prevCheckpointPath": f"{tmp_path}/state0.tar" if k else None,
        }
        (tmp_path / "q.yaml").write_text(yaml.safe_dump(request))
        assert cli.main(["transform", f"{tmp_path}/q.yaml", f"{tmp_path}/r.yaml", "--tar"]) == 0
        totals.append([(r["op"], r["total"]) for r in pq.read_table(f"{tmp_path}/new{k}.parquet").to_pylist()])
    assert totals == [[(0, 10)], [(1, 10), (0, 21)]]
    assert sorted(p.name for p in tmp_path.iterdir() if "state" in p.name) == ["state0.tar", "state1.tar"]


@pytest.mark.parametrize("zone", [None, "UTC"])
def test_nanoseconds_are_times(spark, tmp_path, zone):
    t = pa.table({"offset": pa.array([0, 1], pa.int64()), "op": pa.array([0, 2], pa.int32()), "system_time": pa.array([0, 0], pa.timestamp("ns", zone)), "event_time": pa.array([1_500_000_000_123_456_789, -1], pa.timestamp("ns", zone)), "n": pa.array([1, None], pa.int64())})
    pq.write_table(t, f"{tmp_path}/x.parquet", version="2.6")
    rows = read_slice(spark, Input("in", [f"{tmp_path}/x.parquet"], f"{tmp_path}/x.parquet", (0, 1), [], Vocab()))
    assert dict(rows.dtypes) == {"offset": "bigint", "op": "int", "system_time": "timestamp", "event_time": "timestamp", "n": "bigint"}
    assert rows.selectExpr("op", "unix_micros(event_time)", "n").collect() == [(0, 1_500_000_000_123_456, 1), (2, -1, None)]
    got = execute_raw_query(spark, RawQueryRequest([f"{tmp_path}/x.parquet"], Transform([Step("SELECT TUMBLE_START(event_time, INTERVAL '1' DAY) AS d, count(*) AS n FROM input GROUP BY TUMBLE(event_time, INTERVAL '1' DAY)")]), f"{tmp_path}/o.parquet"))
    assert got.num_records == 2


def test_request_files(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x int").coalesce(1).write.parquet(f"{tmp_path}/in")
    for query, code, kind in (("SELECT x * 2 AS x FROM input", 0, "Success"), ("SELECT y FROM input", 1, "InvalidQuery")):
        request = {"inputDataPaths": [f"{tmp_path}/in"], "transform": {"kind": "Sql", "engine": "flink", "query": query}, "outputDataPath": f"{tmp_path}/out.parquet"}
        (tmp_path / "request.yaml").write_text(yaml.safe_dump(request))
        assert cli.main(["raw-query", str(tmp_path / "request.yaml"), str(tmp_path / "response.yaml")]) == code
        assert yaml.safe_load((tmp_path / "response.yaml").read_text())["kind"] == kind
    columns = {"offset": [0, 1], "op": [0, 0], "system_time": [SYS] * 2, "event_time": [day(1), day(2)], "symbol": ["A", "B"], "price": [10, 20]}
    types = {"offset": pa.int64(), "op": pa.int32(), "system_time": pa.timestamp("ms", "UTC"), "event_time": pa.timestamp("ms", "UTC"), "symbol": pa.string(), "price": pa.int32()}
    for k in range(2):  # a slice of two files
        pq.write_table(pa.table({c: pa.array(columns[c][k : k + 1], t) for c, t in types.items()}), f"{tmp_path}/{k}.parquet")
    request = {
        "transform": {"kind": "Sql", "engine": "flink", "query": "SELECT event_time, symbol, price * 10 AS price FROM `in`"},
        "queryInputs": [{"queryAlias": "in", "schemaFile": f"{tmp_path}/0.parquet", "dataPaths": [f"{tmp_path}/{k}.parquet" for k in range(2)], "offsetInterval": {"start": 0, "end": 1}, "explicitWatermarks": [{"systemTime": "2020-01-01T00:00:00Z", "eventTime": "2000-01-02T00:00:00Z"}], "vocab": {"eventTimeColumn": "event_time"}}],
        "systemTime": "2020-01-01T00:00:00Z", "nextOffset": 7, "newDataPath": f"{tmp_path}/new.parquet", "newCheckpointPath": f"{tmp_path}/state",
    }
    (tmp_path / "request.yaml").write_text(yaml.safe_dump(request))
    assert cli.main(["transform", str(tmp_path / "request.yaml"), str(tmp_path / "response.yaml")]) == 0
    assert yaml.safe_load((tmp_path / "response.yaml").read_text()) == {"kind": "Success", "newOffsetInterval": {"start": 7, "end": 8}, "newWatermark": "2000-01-02T00:00:00Z"}
    out = pq.ParquetFile(f"{tmp_path}/new.parquet")
    assert [(c.name, c.physical_type, str(c.logical_type)) for c in map(out.schema.column, range(len(out.schema)))] == [
        ("offset", "INT64", "None"), ("op", "INT32", "None"),
        *((n, "INT64", "Timestamp(isAdjustedToUTC=true, timeUnit=milliseconds, is_from_converted_type=false, force_set_converted_type=false)") for n in ("system_time", "event_time")),
        ("symbol", "BYTE_ARRAY", "String"), ("price", "INT32", "None"),
    ]
    assert out.read().to_pydict()["price"] == [100, 200] and out.read().to_pydict()["offset"] == [7, 8]


@pytest.mark.parametrize("name,query", [("flink-less", "spork")])
def test_unknown_engines_fail(spark, tmp_path, name, query):
    got = execute_raw_query(spark, RawQueryRequest([], Transform([Step("SELECT 1")], query), f"{tmp_path}/o"))
    assert got.kind == "InternalError" and "Unsupported engine" in got.message


def test_inputs_need_their_columns(spark, tmp_path):
    for k, schema in enumerate(("offset long, event_time timestamp", "offset long, op int, x int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{k}")
        with pytest.raises(ValueError, match="Operation column not found: op" if k == 0 else "Event time column not found: event_time"):
            read_slice(spark, Input("in", [f"{tmp_path}/{k}"], None, (0, 9), [], Vocab()))


def test_times_nested_values_and_partition_columns(spark, tmp_path):
    """Milli- and microseconds are the same times; arrays, maps and structs pass; folders that are named by values give columns."""
    for unit, k in (("ms", 1), ("us", 1000)):
        t = pa.table({"offset": pa.array([0], pa.int64()), "op": pa.array([0], pa.int32()), "event_time": pa.array([86_400_123 * k], pa.timestamp(unit, "UTC")), "a": pa.array([[1, None]], pa.list_(pa.int32())), "m": pa.array([[("k", 1.5)]], pa.map_(pa.string(), pa.float64())), "s": pa.array([{"x": True}], pa.struct({"x": pa.bool_()}))})
        (tmp_path / unit / "symbol=A").mkdir(parents=True)
        pq.write_table(t, f"{tmp_path}/{unit}/symbol=A/x.parquet")
        rows = read_slice(spark, Input("in", [f"{tmp_path}/{unit}"], f"{tmp_path}/{unit}", (0, 0), [], Vocab())).collect()
        assert [(r.event_time, r.a, r.m, r.s.x, r.symbol) for r in rows] == [(dt.datetime(1970, 1, 2, 0, 0, 0, 123_000), [1, None], {"k": 1.5}, True, "A")]
