"""Queries over the example tables, one or more for each operator, with their equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.dialect import translate
from tidewright.operators import asof_join, drop_late, snapshot, top_changes
from tidewright.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY 1, 2
""")
def tumbling_day_minmax(spark: SparkSession, folder: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return table(spark, folder, "events").groupBy(w, "event_type").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value")).select(F.col("window.start").alias("day"), "event_type", "min_value", "max_value")


def _views(spark: SparkSession, folder: str, *names: str) -> None:
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


def same_sql(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query in the engine's dialect, with the oracle's text where that differs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        _views(spark, folder, *tables.split())
        return spark.sql(translate(sql))

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


@query("""
SELECT w::TIMESTAMP AS day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * o AS w, event_type FROM events, (VALUES (0), (1)) t(o)) GROUP BY 1, 2
""")
def hop_2d_1d(spark, folder):
    return table(spark, folder, "events").groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


@query("""
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, g
""")
def session_12h(spark, folder):
    return table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


@query("""
SELECT (date_trunc('day', ts) + INTERVAL 6 HOUR * s)::TIMESTAMP AS until_time, event_type, count(*) AS n FROM events, (VALUES (1), (2), (3), (4)) t(s)
WHERE ts < date_trunc('day', ts) + INTERVAL 6 HOUR * s GROUP BY 1, 2
""")
def cumulate_6h_1d(spark, folder):
    """Windows that grow by 6 hours up to a day: counted by the smallest step first, then summed."""
    e = table(spark, folder, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("k"))
    day = F.window(F.col("w.start"), "1 day").start
    s = e.withColumn("day", day).withColumn("first", (F.hour("w.start") / 6).cast("int") + 1)
    s = s.withColumn("s", F.explode(F.sequence("first", F.lit(4)))).groupBy("day", "s", "event_type").agg(F.sum("k").alias("n"))
    return s.select(F.expr("day + make_dt_interval(0, 6 * s)").alias("until_time"), "event_type", "n")


@query("""
WITH a AS (SELECT *, event_id + (event_id * 7919) % 40 AS arr FROM events),
b AS (SELECT *, max(ts) OVER (ORDER BY arr, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS wm FROM a)
SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM b WHERE wm IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND > wm GROUP BY 1, 2
""")
def late_drop_tumbling(spark, folder):
    e = table(spark, folder, "events").withColumn("arr", (F.col("event_id") + F.col("event_id") * 7919 % 40) * 100_000_000 + F.col("event_id"))
    kept = drop_late(e, "ts", "arr", "1 hour", "1 hour", bucket=100_000_000 * 5000)
    return kept.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


_CLICKS, _BUYS = "event_type = 'click'", "event_type = 'purchase'"


def _asof(spark, folder, outer):
    e = table(spark, folder, "events")
    left = e.where(_BUYS).select("event_id", "user_id", "ts")
    versions = e.where(_CLICKS).groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return asof_join(left, versions, [("user_id", "user_id")], "ts", "ts", "v", outer=outer).select("event_id", "user_id", F.col("v.click_id").alias("click_id"), F.col("v.ts").alias("click_ts"))


_ASOF = f"""
WITH v AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE {_CLICKS} GROUP BY ALL), p AS (SELECT * FROM events WHERE {_BUYS})
SELECT p.event_id, p.user_id, v.click_id, v.ts AS click_ts FROM p ASOF %s JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
"""


@query(_ASOF % "")
def asof_purchase_click(spark, folder):
    return _asof(spark, folder, False)


@query(_ASOF % "LEFT")
def asof_left(spark, folder):
    return _asof(spark, folder, True)


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE r = 1
""")
def snapshot_as_of(spark, folder):
    from datetime import datetime

    return snapshot(table(spark, folder, "events"), ["user_id"], "ts", datetime(2024, 1, 15), "event_id").select("user_id", "event_id", "value")


@query("""
WITH seen AS (SELECT event_id, event_type, list({'low': -value, 'id': event_id}) OVER (PARTITION BY event_type ORDER BY event_id) AS l FROM events),
tops AS (SELECT event_id, event_type, list_slice(list_sort(l), 1, 3) AS now FROM seen),
steps AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY event_type ORDER BY event_id), []) AS was FROM tops),
places AS (SELECT event_id AS arrival, event_type, now, was, unnest([1, 2, 3]) AS place FROM steps WHERE now <> was),
changed AS (SELECT arrival, event_type, place, now[place] AS n, was[place] AS w, 2 * (place - min(place) OVER (PARTITION BY arrival)) AS step FROM places WHERE now[place] IS DISTINCT FROM was[place])
SELECT w.id AS event_id, event_type, -w.low AS value, 2 AS op, place, arrival, step FROM changed WHERE w IS NOT NULL
UNION ALL SELECT n.id, event_type, -n.low, CASE WHEN w IS NULL THEN 0 ELSE 3 END, place, arrival, CASE WHEN w IS NULL THEN step ELSE step + 1 END FROM changed
""")
def top_changelog(spark, folder):
    """Top 3 of each event type by value as a changelog in order of arrival."""
    e = table(spark, folder, "events").select("event_id", "event_type", "value")
    return top_changes(e, [("value", True)], 3, "event_id", ["event_type"]).where("not __final").selectExpr("event_id", "event_type", "value", "__op as op", "__place as place", "__seq as arrival", "__step as step")


def streaming_tumbling(spark, folder):
    from tidewright.streaming import tumbling_counts

    return tumbling_counts(spark, folder, "events.parquet")


QUERIES["streaming_tumbling"] = streaming_tumbling
ORACLES["streaming_tumbling"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2"

for _how in ("LEFT", "INNER", "RIGHT", "FULL"):
    same_sql(f"interval_{_how.lower()}_join", "orders lineitem", f"""
SELECT o.o_orderkey, o.o_orderdate, l.l_orderkey, l.l_linenumber, l.l_shipdate, l.l_quantity FROM orders o {_how} JOIN lineitem l
ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '30' DAY""")
same_sql("chain_join_agg_filter", "orders lineitem", """
WITH shipped AS (SELECT o.o_orderdate AS t, o.o_orderkey AS k, CAST(o.o_totalprice AS DECIMAL(18, 2)) AS q, CAST(l.l_quantity AS DECIMAL(18, 2)) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '30' DAY),
stats AS (SELECT TUMBLE_START(t, INTERVAL '1' DAY) AS d, k, count(*) AS c, min(q) AS q, CAST(coalesce(sum(n), 0) AS DECIMAL(28, 2)) AS total FROM shipped GROUP BY TUMBLE(t, INTERVAL '1' DAY), k)
SELECT d, k, c, CAST(q AS DOUBLE) AS q, CAST(total AS DOUBLE) AS total FROM stats WHERE q <> total""", """
WITH shipped AS (SELECT o.o_orderdate AS t, o.o_orderkey AS k, CAST(o.o_totalprice AS DECIMAL(18, 2)) AS q, CAST(l.l_quantity AS DECIMAL(18, 2)) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '30' DAY),
stats AS (SELECT date_trunc('day', t)::TIMESTAMP AS d, k, count(*) AS c, min(q) AS q, CAST(coalesce(sum(n), 0) AS DECIMAL(28, 2)) AS total FROM shipped GROUP BY 1, 2)
SELECT d, k, c, CAST(q AS DOUBLE) AS q, CAST(total AS DOUBLE) AS total FROM stats WHERE q <> total""")
same_sql("map_projection", "orders", "SELECT o_orderkey, o_orderkey * 10 AS key10, -o_custkey AS minus, upper(o_orderpriority) AS priority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders WHERE o_orderstatus <> 'O'")
same_sql("topn_per_type", "events", "SELECT event_type, event_id, value, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS place FROM events) t WHERE place <= 3")
same_sql("topn_global", "events", "SELECT event_id, value, place FROM (SELECT *, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS BIGINT) AS place FROM events) t WHERE place <= 10")
same_sql("window_topn", "events", "SELECT day, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS r FROM (SELECT TUMBLE_START(ts, INTERVAL '1' DAY) AS day, event_type, count(*) AS n FROM events GROUP BY TUMBLE(ts, INTERVAL '1' DAY), event_type) t) t WHERE r <= 2", "SELECT day, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS r FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) t) t WHERE r <= 2")
same_sql("dedup_first", "events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) t WHERE r = 1")
same_sql("rank_family", "events", "SELECT event_id, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)")
same_sql("lag_lead", "events", "SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id, 2) OVER w AS after_id, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
same_sql("range_frame", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
same_sql("rows_frame", "events", "SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS low FROM events")
same_sql("aggregates", "events", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS DOUBLE) AS total, CAST(round(avg(CAST(value AS DECIMAL(18, 4))), 4) AS DOUBLE) AS mean, round(stddev_pop(value), 4) AS sp, round(stddev_samp(value), 4) AS ss, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
same_sql("listagg_first_last", "nation", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, min_by(n_name, n_nationkey) AS first_name, max_by(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey".replace("string_agg(n_name, ',' ORDER BY n_name)", "listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)"), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_min(n_name, n_nationkey) AS first_name, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey")
for _name, _by in (("cube", "CUBE (event_type, user_id % 3)"), ("rollup", "ROLLUP (event_type, user_id % 3)"), ("grouping_sets", "GROUPING SETS ((event_type), (user_id % 3), ())")):
    same_sql(_name, "events", f"SELECT event_type, user_id % 3 AS u, count(*) AS n, CAST(grouping(event_type) AS INT) AS g FROM events GROUP BY {_by} HAVING count(*) > 1")
same_sql("having", "orders", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same_sql("regular_join", "customer orders nation", "SELECT n.n_name, count(*) AS n, CAST(CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
same_sql("theta_join", "region nation", "SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey")
same_sql("semi_join", "customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM (VALUES (1), (2), (3)) t(n_nationkey))")
same_sql("anti_join", "customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
same_sql("union_intersect", "events", "(SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view') UNION ALL (SELECT user_id FROM events WHERE value > 90 UNION SELECT user_id FROM events WHERE value < 1)")
same_sql("except_all", "events", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view'")
same_sql("intersect_all", "events", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'view'")
same_sql("distinct_values", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same_sql("order_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
same_sql("trycast_decimal", "orders", "SELECT o_orderkey, CAST(TRY_CAST(concat(CAST(o_orderkey AS STRING), '12345678.5') AS DECIMAL(13, 4)) AS STRING) AS d, CAST(CAST(o_orderkey AS DECIMAL(20, 4)) AS STRING) AS s FROM orders", "SELECT o_orderkey, CAST(TRY_CAST(concat(CAST(o_orderkey AS VARCHAR), '12345678.5') AS DECIMAL(13, 4)) AS VARCHAR) AS d, CAST(CAST(o_orderkey AS DECIMAL(20, 4)) AS VARCHAR) AS s FROM orders")
same_sql("string_functions", "nation", "SELECT n_nationkey, char_length(n_name) AS n, lower(n_name) AS l, position('A' IN n_name) AS p, substring(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, md5(n_name) AS h, n_name || '!' AS c, ascii(n_name) AS a, left(n_name, 2) AS lf, right(n_name, 2) AS rt, TO_BASE64(n_name) AS b64, SPLIT_INDEX(n_name, 'A', 1) AS part, IS_DIGIT(n_name) AS dig FROM nation", "SELECT n_nationkey, length(n_name)::INT AS n, lower(n_name) AS l, position('A' IN n_name)::INT AS p, substring(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, md5(n_name) AS h, n_name || '!' AS c, ascii(n_name)::INT AS a, left(n_name, 2) AS lf, right(n_name, 2) AS rt, to_base64(encode(n_name)) AS b64, CASE WHEN contains(n_name, 'A') THEN string_split(n_name, 'A')[2] END AS part, regexp_full_match(n_name, '[0-9]+') AS dig FROM nation")
same_sql("time_functions", "events", "SELECT event_id, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS m, extract(DAY FROM ts) AS d, hour(ts) AS h, CAST(CAST(ts AS DATE) AS STRING) AS dt, quarter(ts) AS q, WEEK(ts) AS w, CAST(FLOOR(ts TO DAY) AS TIMESTAMP_NTZ) AS fl, ts + INTERVAL '2' DAY AS later, CAST(date_format(ts, 'yyyyMM') AS INT) AS f FROM events", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, hour(ts)::INT AS h, ts::DATE::VARCHAR AS dt, quarter(ts)::INT AS q, week(ts)::INT AS w, date_trunc('day', ts)::TIMESTAMP AS fl, ts + INTERVAL 2 DAY AS later, strftime(ts, '%Y%m')::INT AS f FROM events")
same_sql("math_functions", "orders", "SELECT o_orderkey, o_orderkey % 7 AS m, abs(-o_orderkey) AS a, round(sqrt(o_orderkey), 6) AS s, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, sign(o_totalprice) AS g, greatest(o_orderkey, o_custkey) AS gr, least(o_orderkey, o_custkey) AS le, coalesce(nullif(o_orderkey, 3), -1) AS n FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, abs(-o_orderkey) AS a, round(sqrt(o_orderkey), 6) AS s, floor(o_totalprice)::BIGINT AS f, ceil(o_totalprice)::BIGINT AS c, sign(o_totalprice)::DOUBLE AS g, greatest(o_orderkey, o_custkey) AS gr, least(o_orderkey, o_custkey) AS le, coalesce(nullif(o_orderkey, 3), -1) AS n FROM orders")
same_sql("json_field", "events", "SELECT event_id, JSON_VALUE(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
same_sql("unnest_arrays", "embeddings", "SELECT vec_id, label, cardinality(embedding) AS n, embedding[0] AS first_value FROM embeddings".replace("embedding[0]", "element_at(embedding, 1)"), "SELECT vec_id, label, len(embedding)::INT AS n, embedding[1] AS first_value FROM embeddings")
same_sql("predicates", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderpriority LIKE '1%' OR o_orderstatus IN ('F', 'P')) AND o_custkey IS NOT NULL AND NOT (o_totalprice < 1000) AND o_orderstatus IS DISTINCT FROM 'P'")

_PER_WINDOW = "SELECT window_start, window_end, event_type, count(*) AS n, max(value) AS high FROM TABLE({}) GROUP BY window_start, window_end, event_type"
same_sql("window_table_tumble", "events", _PER_WINDOW.format("TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '6' HOUR)"), "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS window_start, (time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR)::TIMESTAMP AS window_end, event_type, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
same_sql("window_table_hop", "events", _PER_WINDOW.format("HOP(DATA => TABLE events, TIMECOL => DESCRIPTOR(ts), SLIDE => INTERVAL '1' DAY, SIZE => INTERVAL '2' DAY)"), "SELECT (date_trunc('day', ts) - INTERVAL 1 DAY * k)::TIMESTAMP AS window_start, (date_trunc('day', ts) - INTERVAL 1 DAY * k + INTERVAL 2 DAY)::TIMESTAMP AS window_end, event_type, count(*) AS n, max(value) AS high FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
same_sql("window_table_cumulate", "events", _PER_WINDOW.format("CUMULATE(TABLE events, DESCRIPTOR(ts), INTERVAL '6' HOUR, INTERVAL '1' DAY)"), "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 6 HOUR * k)::TIMESTAMP AS window_end, event_type, count(*) AS n, max(value) AS high FROM events, (VALUES (1), (2), (3), (4)) t(k) WHERE ts < date_trunc('day', ts) + INTERVAL 6 HOUR * k GROUP BY ALL")
same_sql("fetch_first", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 20 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
same_sql("between_symmetric", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN SYMMETRIC o_custkey + 100 AND 2 * o_custkey AND o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN least(o_custkey + 100, 2 * o_custkey) AND greatest(o_custkey + 100, 2 * o_custkey) AND o_orderstatus = 'F'")
same_sql("unnest_rows", "nation", "SELECT n_nationkey, part, MAP['a', n_regionkey, 'b', -1]['a'] AS region, ARRAY[n_name, 'x'][1] AS first_part, ARRAY[n_name][2] AS no_part FROM nation CROSS JOIN UNNEST(split(n_name, ' ')) AS t (part)", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS part, n_regionkey AS region, n_name AS first_part, NULL::VARCHAR AS no_part FROM nation")
same_sql("json_functions", "nation", "SELECT n_nationkey, j, JSON_EXISTS(j, '$.k') AS has, JSON_EXISTS(j, '$.none') AS lacks, JSON_VALUE(j, '$.name') AS name, j IS JSON AS is_json, n_name IS NOT JSON AS no_json FROM (SELECT n_nationkey, n_name, JSON_OBJECT(KEY 'k' VALUE n_regionkey, 'name' VALUE n_name, 'z' VALUE CAST(NULL AS INT)) AS j FROM nation) t", "SELECT n_nationkey, '{\"k\":' || n_regionkey || ',\"name\":\"' || n_name || '\",\"z\":null}' AS j, true AS has, false AS lacks, n_name AS name, true AS is_json, true AS no_json FROM nation")
same_sql("hash_functions", "nation", "SELECT n_nationkey, SHA256(n_name) AS s, sha1(n_name) AS o, length(SHA224(n_name)) AS n, length(SHA512(n_name)) AS m FROM nation", "SELECT n_nationkey, sha256(n_name) AS s, sha1(n_name) AS o, 56 AS n, 128 AS m FROM nation")
same_sql("similar_to", "nation", "SELECT n_nationkey, n_name SIMILAR TO 'A%' AS a, n_name SIMILAR TO '_(R|H)%' AS b, n_name SIMILAR TO 'R' AS c, 'a.c' SIMILAR TO 'a.c' AS d, 'abc' SIMILAR TO 'a.c' AS e, n_name NOT SIMILAR TO '[A-C]%' AS f FROM nation", "SELECT n_nationkey, regexp_full_match(n_name, 'A.*') AS a, regexp_full_match(n_name, '.(R|H).*') AS b, false AS c, true AS d, false AS e, NOT regexp_full_match(n_name, '[A-C].*') AS f FROM nation")
same_sql("truncate_numbers", "orders", "SELECT o_orderkey, TRUNCATE(o_orderkey) AS k, CAST(TRUNCATE(CAST(o_totalprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS p, CAST(TRUNCATE(-CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS m, TRUNCATE(9007199254740993, 0) AS big, TRUNCATE(o_orderkey, -2) AS h, RAND_INTEGER(10) BETWEEN 0 AND 9 AS r, RAND_INTEGER(7, 5) BETWEEN 0 AND 4 AS s FROM orders", "SELECT o_orderkey, o_orderkey AS k, (trunc(CAST(o_totalprice AS DECIMAL(18, 2)) * 10) / 10)::DOUBLE AS p, -trunc(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS m, 9007199254740993 AS big, o_orderkey // 100 * 100 AS h, true AS r, true AS s FROM orders")
same_sql("time_dialect", "events", "SELECT event_id, date_format(TO_TIMESTAMP_LTZ(event_id, 0), 'yyyy-MM-dd HH:mm:ss') AS a, date_format(TO_TIMESTAMP_LTZ(event_id, 3), 'yyyy-MM-dd HH:mm:ss.SSS') AS b, date_format(CAST(TIMESTAMP '2024-01-01 00:00:00.123956' AS TIMESTAMP(3)), 'HH:mm:ss.SSSSSS') AS c, date_format(CAST(TIMESTAMP '2024-01-01 00:00:01.9' AS TIMESTAMP(0)), 'HH:mm:ss.SSS') AS d, LOCALTIMESTAMP IS NOT NULL AND LOCALTIME IS NOT NULL AND now() IS NOT NULL AS e, TIMESTAMPDIFF(HOUR, TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) AS f, dayofyear(ts) AS g, CAST(dayofweek(ts) AS INT) AS h, date_format(CEIL(TIMESTAMP '2024-01-01 10:20:00' TO HOUR), 'HH:mm') AS i, CONVERT_TZ('2024-01-01 00:00:00', 'UTC', 'America/Los_Angeles') AS j, (TIMESTAMP '2024-01-01 09:00:00', TIMESTAMP '2024-01-01 10:00:00') OVERLAPS (TIMESTAMP '2024-01-01 10:15:00', INTERVAL '3' HOUR) AS k, (TIMESTAMP '2024-01-01 02:55:00', INTERVAL '1' HOUR) OVERLAPS (TIMESTAMP '2024-01-01 03:30:00', INTERVAL '2' HOUR) AS l FROM events", "SELECT event_id, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS a, strftime(make_timestamp(event_id * 1000), '%Y-%m-%d %H:%M:%S.%g') AS b, '00:00:00.123000' AS c, '00:00:01.000' AS d, true AS e, epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') // 3600000000 AS f, dayofyear(ts)::INT AS g, dayofweek(ts)::INT + 1 AS h, '11:00' AS i, '2023-12-31 16:00:00' AS j, false AS k, true AS l FROM events")
same_sql("json_dialect", "nation", """SELECT n_nationkey, JSON_STRING(n_name) AS s, JSON_ARRAY(n_regionkey, n_name, CAST(NULL AS STRING)) AS a, JSON_ARRAY(n_regionkey, CAST(NULL AS STRING) NULL ON NULL) AS n, JSON_VALUE('{"a": {"b": 1}, "c": 7}', '$.a') AS o, JSON_VALUE('{"a": {"b": 1}, "c": 7}', '$.c' RETURNING INT) AS c, JSON_VALUE('no json', '$.c') AS x FROM nation""", """SELECT n_nationkey, '"' || n_name || '"' AS s, '[' || n_regionkey || ',"' || n_name || '"]' AS a, '[' || n_regionkey || ',null]' AS n, NULL::VARCHAR AS o, 7 AS c, NULL::VARCHAR AS x FROM nation""")
same_sql("json_aggregates", "region", "SELECT r_regionkey, JSON_OBJECTAGG(KEY r_name VALUE r_regionkey) AS o, JSON_ARRAYAGG(r_name) AS a FROM region GROUP BY r_regionkey", """SELECT r_regionkey, '{"' || r_name || '":' || r_regionkey || '}' AS o, '["' || r_name || '"]' AS a FROM region""")
same_sql("string_dialect", "nation", "SELECT n_nationkey, IS_DECIMAL('NaN') AS a, IS_DECIMAL('-1.5e3') AS b, IS_DIGIT('12') AND NOT IS_DIGIT('1a') AND IS_ALPHA('ab') AS c, SPLIT_INDEX('a.b.c', '.', 1) AS d, STR_TO_MAP('a=1,b=2')['b'] AS e, STR_TO_MAP('a:1;b:2', ';', ':')['a'] AS f, FROM_BASE64(TO_BASE64(n_name)) AS g, initcap(n_name) AS h, overlay(n_name PLACING '--' FROM 2 FOR 2) AS i, chr(65) AS j, instr(n_name, 'A') AS k, right(n_name, 2) AS l, concat_ws('-', n_name, 'x') AS m, regexp_replace(n_name, '[AEIOU]', '.') AS n, regexp_extract(n_name, '([AEIOU])', 1) AS o, repeat('ab', 2) AS p, trim(BOTH 'A' FROM n_name) AS q, locate('N', n_name) AS r FROM nation", "SELECT n_nationkey, false AS a, true AS b, true AS c, 'b' AS d, '2' AS e, '1' AS f, n_name AS g, list_aggregate(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS h, n_name[1:1] || '--' || n_name[4:] AS i, 'A' AS j, instr(n_name, 'A')::INT AS k, right(n_name, 2) AS l, n_name || '-x' AS m, regexp_replace(n_name, '[AEIOU]', '.', 'g') AS n, regexp_extract(n_name, '([AEIOU])', 1) AS o, 'abab' AS p, trim(n_name, 'A') AS q, instr(n_name, 'N')::INT AS r FROM nation")
same_sql("math_dialect", "nation", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS a, round(cos(n_nationkey), 9) AS b, round(atan2(n_nationkey, 2), 9) AS c, round(ln(n_nationkey + 1), 9) AS d, round(log10(n_nationkey + 1), 9) AS e, round(log2(n_nationkey + 1), 9) AS f, round(exp(n_nationkey / 10.0), 6) AS g, round(power(n_nationkey, 2), 3) AS h, round(degrees(pi()), 6) AS i, round(radians(180), 9) AS j, round(cot(n_nationkey + 1), 6) AS k, round(sinh(n_nationkey / 10.0), 6) AS l, mod(n_nationkey, 4) AS m, bin(n_nationkey) AS n, hex(n_nationkey) AS o, round(e(), 9) AS p FROM nation", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS a, round(cos(n_nationkey), 9) AS b, round(atan2(n_nationkey, 2), 9) AS c, round(ln(n_nationkey + 1), 9) AS d, round(log10(n_nationkey + 1), 9) AS e, round(log2(n_nationkey + 1), 9) AS f, round(exp(n_nationkey / 10.0), 6) AS g, round(power(n_nationkey, 2), 3) AS h, 180.0::DOUBLE AS i, round(pi(), 9) AS j, round(cot(n_nationkey + 1), 6) AS k, round(sinh(n_nationkey / 10.0), 6) AS l, n_nationkey % 4 AS m, bin(n_nationkey) AS n, upper(to_hex(n_nationkey)) AS o, round(exp(1.0::DOUBLE), 9) AS p FROM nation")
same_sql("logic_dialect", "orders", "SELECT o_orderkey, (o_orderkey > 100) IS TRUE AS a, (nullif(o_orderkey, 3) > 5) IS UNKNOWN AS b, (nullif(o_orderkey, 3) > 5) IS NOT FALSE AS c, if(o_orderkey > 5, 'x', 'y') AS d, ifnull(nullif(o_orderkey, 3), 0) AS e, nullif(o_orderkey, 3) IS NOT DISTINCT FROM NULL AS f FROM orders", "SELECT o_orderkey, o_orderkey > 100 AS a, o_orderkey = 3 AS b, o_orderkey = 3 OR o_orderkey > 5 AS c, CASE WHEN o_orderkey > 5 THEN 'x' ELSE 'y' END AS d, CASE WHEN o_orderkey = 3 THEN 0 ELSE o_orderkey END AS e, o_orderkey = 3 AS f FROM orders")
same_sql("window_rowtimes", "events", "SELECT date_format(TUMBLE_ROWTIME(ts, INTERVAL '1' DAY), 'yyyy-MM-dd HH:mm:ss.SSS') AS t, count(*) AS n FROM events GROUP BY TUMBLE(ts, INTERVAL '1' DAY)", "SELECT strftime(date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS t, count(*) AS n FROM events GROUP BY 1")
same_sql("hop_rowtimes", "events", "SELECT date_format(HOP_ROWTIME(ts, INTERVAL '1' DAY, INTERVAL '2' DAY), 'yyyy-MM-dd HH:mm:ss.SSS') AS t, count(*) AS n FROM events GROUP BY HOP(ts, INTERVAL '1' DAY, INTERVAL '2' DAY)", "SELECT strftime(date_trunc('day', ts) + INTERVAL 1 DAY * (1 + k) - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS t, count(*) AS n FROM events, range(2) r(k) GROUP BY 1")
same_sql("session_rowtimes", "events", "SELECT user_id, date_format(SESSION_ROWTIME(ts, INTERVAL '12' HOUR), 'yyyy-MM-dd HH:mm:ss.SSS') AS t, count(*) AS n FROM events GROUP BY SESSION(ts, INTERVAL '12' HOUR), user_id", "WITH f AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, strftime(max(ts) + INTERVAL 12 HOUR - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS t, count(*) AS n FROM s GROUP BY user_id, k")
