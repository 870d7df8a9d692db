"""URL filter: rules, and beyond them a path-template tree judged by smoothed labelled purity. DataFrame functions only.

Rules are `host/path prefix` strings; one fits its host and all subdomains if the path begins with the rule's, and the
longest that fits decides. Urls that a rule decides are the labels of the tree for those that none does.

Below a root, which has the rate of all labels, stand the hosts, and below each the segments of its paths, however many; where a
path ends, an empty segment stands. A segment stays literal if it holds the square root of its parent's urls or more, so
that at most as many sections stay literal however evenly the urls are spread, or if LABELS labelled urls support it; the
others are generalised into one wildcard branch. A branch without labels, or whose blocked share does not differ from its
parent's (a z test), is merged with the parent. Of the others, siblings with similar shares (smoothed towards the parent's
purity, and equal when the arc sine of their root is rounded to BIN) are merged, and their counts are pooled for one purity
smoothed towards the parent's. A branch whose labels all agree has no parts that differ, so the tree goes down only
where labels are mixed. Urls of templates with a purity of REJECT or more are blocked.

Pages are read twice: for the counts of distinct paths, from which all levels are computed, and to be judged. Each level is
kept in the shared folder. Counts are sums with partial aggregation, and joins by a key that many rows hold are salted, so
a host, branch or url with a third of all rows is spread. Sums of all labels and sizes of the largest keys alone reach the driver.

Defined results: a null url, or one without `://`, has empty host and path and is judged as the host ``; repeated rows are
judged each; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import lower_ascii, spread
from tidewright.session import cut
from tidewright.sources import table

NAME = "op2_url_filter"
#: Rule and verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
LABELS = 8
BIN = 0.1
Z = 1.96
WEIGHT = 5.0
REJECT = 0.9


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), x)):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & (path.startswith("/" + p))
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def _level(live: DataFrame, depth: int) -> DataFrame:
    """live(host, segs, n, l, b, node, all, q): distinct paths with their urls, labels and blocked ones, the node that each has come
    to, its urls and its purity. Gives each one's node a level below, and whether that has mixed labels."""
    live = live.withColumn("seg", F.coalesce(F.get("segs", F.lit(depth)), F.lit("")))
    sums = [F.sum(c).alias(c) for c in ("n", "l", "b")]
    kept = [F.max(c).alias(c) for c in ("all", "q")]
    kids = live.groupBy("node", "seg").agg(*sums, *kept, F.count("*").alias("paths"))
    literal = F.lit(True) if not depth else (F.col("n") * F.col("n") >= F.col("all")) | (F.col("l") >= LABELS)
    kids = kids.withColumn("part", F.when(literal, F.concat(F.lit("/"), F.col("seg"))).otherwise("*"))
    q, l, b = F.col("q"), F.col("l"), F.col("b")
    alike = (l == 0) | (F.abs(b / F.nullif(l, F.lit(0)) - q) <= Z * F.sqrt(q * (1.0 - q) / F.nullif(l, F.lit(0))))
    like = F.when(~alike, F.round(F.asin(F.sqrt((b + WEIGHT * q) / (l + WEIGHT))) / BIN)).alias("like")
    nodes = kids.groupBy("node", "part").agg(*sums, *kept, F.sum("paths").alias("paths")).select("*", like)
    pooled = nodes.where("like is not null").groupBy("node", "like").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"))
    mixed = (b > 0) & (b < l) & (F.lit(not depth) | (F.col("part") != "/"))
    found = nodes.join(pooled, ["node", "like"], "left").select("node", "part", "paths", F.col("n").alias("now_all"), F.when(F.col("like").isNull(), q).otherwise((F.col("mb") + WEIGHT * q) / (F.col("ml") + WEIGHT)).alias("now_q"), mixed.alias("mixed"))
    found = cut(found)
    told = ["now_all", "now_q", "mixed"]
    most = found.groupBy(F.col("part") == "*").agg(F.max("paths")).collect()
    in_named, in_rest = (next((n for star, n in most if star is which), 0) for which in (False, True))
    named = kids.where("part <> '*'").select("node", "part", "seg").join(found, ["node", "part"]).select("node", "seg", "paths", *told)
    rest = found.where("part = '*'").select("node", F.col("paths").alias("others"), *[F.col(c).alias(f"rest_{c}") for c in told])
    out = spread(spread(live, named, ["node", "seg"], "paths", "left", ["segs"], in_named), rest, ["node"], "others", "left", ["segs"], in_rest)
    own = F.col("paths").isNotNull()
    node = F.concat("node", F.when(own, F.concat(F.lit("/"), F.col("seg"))).otherwise("/*"))
    return cut(out.select("host", "segs", "n", "l", "b", node.alias("node"), *[F.when(own, F.col(c)).otherwise(F.col(f"rest_{c}")).alias(c.removeprefix("now_")) for c in told]))


def judge(pages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of pages(page_id, url)."""
    rules = RULES if rules is None else rules
    host, path = split_url(F.col("url"))
    verdicts = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None
    base = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("told", F.element_at(verdicts, F.coalesce("rule", F.lit(""))) if rules else F.lit(None).cast("string"))
    base = base.withColumn("segs", F.concat(F.array("host"), F.filter(F.split("path", "/"), lambda x: x != "")))
    paths = cut(base.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("told").alias("l"), F.count_if(F.col("told") == "block").alias("b")))
    total = paths.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("l", "b")], F.coalesce(F.max("n"), F.lit(0))).first()
    live, depth, done = paths.withColumns({"node": F.lit(""), "all": F.lit(0).cast("long"), "q": F.lit((total[1] + 1.0) / (total[0] + 2.0))}), 0, []
    while True:
        now = _level(live, depth)
        done.append(now.where("not mixed"))
        live, depth = now.where("mixed").drop("mixed"), depth + 1
        if live.isEmpty():
            break
    judged = functools.reduce(DataFrame.unionByName, done).select("segs", "n", F.col("node").alias("template"), F.col("q").alias("purity"))
    out = spread(base, judged, ["segs"], "n", by=["page_id"], most=total[2])
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r in sorted(RULES, key=lambda x: (-len(x), x)) for h, _, p in [r.partition("/")]) + " END"
    told = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule, list_concat([host], list_filter(string_split(path, '/'), lambda x: x <> '')) AS segs FROM h),
base AS (SELECT *, {told} AS told FROM r),
p AS (SELECT segs, count(*) AS n, count(told) AS l, count(*) FILTER (WHERE told = 'block') AS b FROM base GROUP BY segs),
tree AS (
  SELECT 0 AS depth, segs, n, l, b, '' AS node, 0::DOUBLE AS whole, (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(l), 0) + 2.0::DOUBLE) FROM p) AS q, true AS mixed FROM p
  UNION ALL
  SELECT depth + 1, segs, n, l, b, node || '/' || part, nn, CASE WHEN like_ IS NULL THEN q ELSE (sum(b) OVER z + {WEIGHT}::DOUBLE * q) / (sum(l) OVER z + {WEIGHT}::DOUBLE) END,
    nb > 0 AND nb < nl AND (depth = 0 OR part <> '/')
  FROM (
    SELECT *, CASE WHEN nl = 0 OR abs(nb / nullif(nl, 0) - q) <= {Z}::DOUBLE * sqrt(q * (1.0::DOUBLE - q) / nullif(nl, 0)) THEN NULL ELSE round(asin(sqrt((nb + {WEIGHT}::DOUBLE * q) / (nl + {WEIGHT}::DOUBLE))) / {BIN}::DOUBLE) END AS like_
    FROM (
      SELECT *, (sum(n) OVER y)::DOUBLE AS nn, (sum(l) OVER y)::DOUBLE AS nl, (sum(b) OVER y)::DOUBLE AS nb
      FROM (
        SELECT *, CASE WHEN depth = 0 OR (sum(n) OVER x)::DOUBLE * sum(n) OVER x >= whole OR sum(l) OVER x >= {LABELS} THEN '/' || seg ELSE '*' END AS part
        FROM (SELECT *, coalesce(segs[depth + 1], '') AS seg FROM tree WHERE mixed)
        WINDOW x AS (PARTITION BY node, seg)
      ) WINDOW y AS (PARTITION BY node, part)
    )
  ) WINDOW z AS (PARTITION BY node, like_)
),
judged AS (SELECT segs, arg_max(q, depth) AS q FROM tree GROUP BY segs)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN q >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM base JOIN judged USING (segs)
"""


ORACLE = _oracle()
