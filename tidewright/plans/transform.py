"""Incremental transformations: a slice of each input, explicit watermarks, state from one run to the next.

Each stateful step emits the part of its answer that has become final and keeps the rows that it still needs, as Parquet
in the checkpoint folder. What it emits is the next step's slice, with the watermark that the step's kind implies.
"""

from __future__ import annotations

import logging
import re
import traceback
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright import dialect
from tidewright.model import APPEND, CORRECT_FROM, CORRECT_TO, ENGINES, RETRACT, Failure, InvalidQueryError, Success, TransformRequest
from tidewright.operators import asof_join, top_changes, with_offsets
from tidewright.session import cut
from tidewright.sinks import load_json, save_json, write_file
from tidewright.sources.slices import read_slice

#: Messages that callers of the engine look for.
CLASH = "Transformed data contains column '{}' that conflicts with the system column name, you should either rename the data column or configure the dataset vocabulary to use a different name"
NO_TIME = "Event time column {} was not found among: {}"
LOG = logging.getLogger("tidewright")
_EVER = datetime(1, 1, 1)
_MS = timedelta(milliseconds=1)
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _delta(text: str | None) -> timedelta:
    if not text:
        return timedelta(0)
    n, unit = text.split()
    if unit not in _SECONDS:
        raise InvalidQueryError(f"No fixed length: {text}")
    return timedelta(seconds=float(n) * _SECONDS[unit])


def _interval(size: str) -> str:
    n, unit = size.split()
    return f"INTERVAL '{n}' {unit}"


def _field(item: str) -> str:
    """An item of a select list as name and value."""
    m = re.fullmatch(r"(.*?)\s+AS\s+(`[^`]+`|\w+)\s*", item, re.I | re.S) or re.fullmatch(r"(`[^`]+`|\w+)", item)
    if not m:
        raise InvalidQueryError(f"A computed column needs a name: {item}")
    return f"'{m[m.lastindex].strip('`')}', {m[1]}"


def _less(t: datetime, d: timedelta) -> datetime:
    return t - d if t - _EVER > d else _EVER


@dataclass
class Relation:
    """A named stream: the rows of this slice, and its watermark before and after them."""

    rows: DataFrame
    before: datetime
    after: datetime


class Run:
    """One execution of a request's steps."""

    def __init__(self, spark: SparkSession, request: TransformRequest):
        self.spark, self.request = spark, request
        self.prev = request.prev_checkpoint or None
        self.marks: dict[str, str] = load_json(spark, f"{self.prev}/_state") if self.prev else {}
        self.now: dict[str, str] = {}
        self.relations: dict[str, Relation] = {}

    def _mark(self, name: str, after: datetime) -> datetime:
        """The watermark that `name` had, its new one being kept."""
        before = datetime.fromisoformat(self.marks[name]) if name in self.marks else _EVER
        self.now[name] = max(before, after).isoformat()
        return before

    def _state(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        if self.prev and name in self.marks.get("tables", "").split(","):
            return self.spark.read.parquet(f"{self.prev}/{name}")
        return None if like is None else like.limit(0)

    def _save(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.request.checkpoint}/{name}")
        self.now["tables"] = ",".join(x for x in (self.now.get("tables", ""), name) if x)

    def load(self) -> None:
        for i in self.request.inputs:
            rows = read_slice(self.spark, i).withColumn("__seq", F.col(i.vocab.offset).cast("long"))
            before = self._mark(f"input/{i.alias}", max([_EVER, *i.watermarks]))
            self.relations[i.alias] = Relation(rows, before, max([before, *i.watermarks]))
            self._count(f"input/{i.alias}", rows.count())
            self._tap(i.alias, self.relations[i.alias])

    def _count(self, name: str, n: int) -> None:
        """Rows that have passed here in all runs, kept with the state."""
        self.now[f"rows/{name}"] = str(int(self.marks.get(f"rows/{name}", 0)) + n)

    def _tap(self, name: str, r: Relation) -> None:
        """Where debugging is on, logs each row of a relation, and its watermark."""
        if LOG.isEnabledFor(logging.DEBUG):
            for row in r.rows.toLocalIterator():
                LOG.debug("%s %s", name, row)
            LOG.debug("%s watermark %s", name, r.after)

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name, df in {**{k: r.rows for k, r in self.relations.items()}, **views}.items():
            df.createOrReplaceTempView(f"`{name}`")
        return self.spark.sql(dialect.translate(text))

    def _with_seq(self, text: str, extra: str, **views: DataFrame) -> DataFrame:
        """The query with hidden columns of its source, where it has a plain select list."""
        return self._sql(re.sub(r"^\s*SELECT\b", f"SELECT {extra},", text, count=1, flags=re.I), **views)

    def _of(self, name: str) -> Relation:
        if name not in self.relations:
            raise InvalidQueryError(f"Unknown table: {name}")
        return self.relations[name]

    def step(self, k: int, text: str) -> Relation:
        text = dialect.snapshots(text, self.request.transform.temporal, {i.alias: i.vocab.event_time for i in self.request.inputs})
        if dialect.CURRENT_WATERMARK.search(text):  # rows of a slice see the watermark that preceded them
            before = min((self._of(x).before for x in dialect.names(text, list(self.relations))), default=_EVER)
            told = "CAST(NULL AS TIMESTAMP)" if before == _EVER else f"TIMESTAMP '{before}'"
            text = dialect.CURRENT_WATERMARK.sub(told, "".join(dialect.tokens(text)))
        try:
            s = dialect.shape(text, self.request.transform.temporal)
        except dialect.NoRuleError:
            s = dialect.Shape("bounded", sql=text)
        if s.kind in ("stateless", "union") and any(len(dialect.names(x, list(self.relations))) > 1 for x in dialect.branches(text)):
            s = dialect.Shape("bounded", sql=text)
        if s.kind == "group" and "__op" in self._of(s.source).rows.columns:  # a row may take back what another gave
            s = dialect.Shape("bounded", sql=text)
        if s.kind in ("interval", "temporal", "top") and any("__op" in self._of(x).rows.columns for x in (s.source, s.right) if x):
            raise InvalidQueryError("Interval joins, temporal joins and ranked tops take rows that are only added, not a changelog")
        return getattr(self, f"_{s.kind}")(f"step{k}", s)

    def _stateless(self, name: str, s: dialect.Shape) -> Relation:
        """Each row by itself; a change stays the change that it is."""
        src = self._of(s.source)
        hidden = [c for c in ("__seq", "__op", "__step") if c in src.rows.columns]
        star = re.match(r"\s*SELECT\s+\*", s.sql, re.I)
        if star or not hidden:
            return Relation(self._sql(s.sql), src.before, src.after)
        text = s.sql
        for m in list(re.finditer(r"\bFROM\s*\(\s*SELECT\b", text, re.I))[::-1]:  # through derived tables too
            if not re.match(r"\s*\*", text[m.end() :]):
                text = f"{text[: m.end()]} {', '.join(hidden)},{text[m.end() :]}"
        return Relation(self._with_seq(text, ", ".join(hidden)), src.before, src.after)

    def _union(self, name: str, s: dialect.Shape) -> Relation:
        """UNION ALL of parts that each row decides by itself: their rows in one order of arrival, by place, then part."""
        parts = [self._stateless(name, dialect.shape(x, {})) for x in dialect.branches(s.sql)]
        out, shown = None, [c for c in parts[0].rows.columns if not c.startswith("__")]
        for k, p in enumerate(parts):
            mine = [c for c in p.rows.columns if not c.startswith("__")]
            if len(mine) != len(shown):
                raise InvalidQueryError("The parts of UNION ALL have different numbers of columns")
            step = F.lit(k).cast("long") * 1_000_000 + (F.col("__step") if "__step" in p.rows.columns else F.lit(0))
            hidden = [F.col("__seq") if "__seq" in p.rows.columns else F.lit(None).cast("long").alias("__seq"), (F.col("__op").cast("int") if "__op" in p.rows.columns else F.lit(APPEND)).alias("__op"), step.alias("__step")]
            now = p.rows.select(*hidden, *[F.col(f"`{c}`").alias(n) for c, n in zip(mine, shown, strict=True)])
            out = now if out is None else out.union(now)
        if not any("__op" in p.rows.columns for p in parts):
            out = out.drop("__op")
        return Relation(out, min(p.before for p in parts), min(p.after for p in parts))

    def _rows(self, kept: DataFrame | None, src: Relation) -> DataFrame:
        """The rows that stand after a slice: those kept and added, without those taken back."""
        rows = src.rows if kept is None else src.rows.unionByName(kept, allowMissingColumns=True)
        if "__op" not in src.rows.columns:
            return rows
        names = [f"`{c}`" for c in rows.columns if not c.startswith("__")]
        sign = F.when(F.coalesce("__op", F.lit(APPEND)).isin(RETRACT, CORRECT_FROM), -1).otherwise(1)
        net = rows.groupBy(*names).agg(F.sum(sign).alias("__n"), F.max("__seq").alias("__seq")) if "__seq" in rows.columns else rows.groupBy(*names).agg(F.sum(sign).alias("__n"))
        return net.where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")

    def _bounded(self, name: str, s: dialect.Shape) -> Relation:
        """Any query, as the bounded one over all rows so far: its result after the slice less its result before, as rows
        added and rows taken back. The state is the inputs' whole history and the last result, which is what a runtime keeps
        for such a query too; the work of a slice grows with them."""
        used = dialect.names(s.sql, list(self.relations))
        if not used:
            return Relation(self._sql(s.sql), _EVER, _EVER)
        views = {}
        for k, r in enumerate(used):
            src, state = self._of(r), f"{name}h{k}"
            rows = cut(self._rows(self._state(state), src))
            self._save(rows, state)
            views[r] = rows.drop(*[c for c in rows.columns if c.startswith("__")])
        now = cut(self._sql(s.sql, **views))
        was = self._state(f"{name}out", now)
        self._save(now, f"{name}out")
        change = lambda rows, op: rows.withColumns({"__op": F.lit(op), "__step": F.lit(int(op == APPEND))})
        out = change(was.exceptAll(now), RETRACT).unionByName(change(now.exceptAll(was), APPEND))
        return Relation(cut(out), min(self._of(r).before for r in used), min(self._of(r).after for r in used))

    def _window(self, name: str, s: dialect.Shape) -> Relation:
        """Tumbling and hopping windows. A row is kept until the last of its windows closes; a window that was closed before
        is not shown again, so a row is late only for the windows that no longer wait for it."""
        src = self._of(s.source)
        hop = s.keys[0][0] if s.keys else s.size
        last = F.window(F.col(s.time), hop).start + F.expr(f"interval '{s.size.split()[0]}' {s.size.split()[1]}") - F.expr("interval 1 millisecond")
        seen = src.rows.withColumn("__end", last).where(F.col("__end") > F.lit(src.before)).drop("__end")
        rows = cut(self._rows(self._state(name), Relation(seen, src.before, src.after)).withColumn("__end", last))
        self._save(rows.where(F.col("__end") > F.lit(src.after)).drop("__end"), name)
        if not s.keys:
            out = self._sql(s.sql, **{s.source: rows.where(F.col("__end") <= F.lit(src.after)).drop("__end", "__seq")})
            return Relation(out, src.before, src.after)
        end = f"HOP_END({s.time}, {', '.join(_interval(x) for x in (hop, s.size))}) AS __end"
        shown = self._with_seq(s.sql, end, **{s.source: rows.drop("__end", "__seq")}).withColumn("__end", F.col("__end") - F.expr("interval 1 millisecond"))
        return Relation(shown.where((F.col("__end") > F.lit(src.before)) & (F.col("__end") <= F.lit(src.after))).drop("__end"), src.before, src.after)

    def _session(self, name: str, s: dialect.Shape) -> Relation:
        """Sessions close as a whole. A late row that still touches an open session of its key joins it; the rows of a slice
        are taken as a set, so their order decides nothing."""
        src = self._of(s.source)
        rows = self._rows(self._state(name), src).where(F.col(s.time).isNotNull())
        key, gap = [F.expr(dialect.translate(k)) for k in s.partition], F.expr(_interval(s.size))
        by_time = Window.partitionBy(*key).orderBy(s.time)
        rows = rows.withColumn("__first", F.coalesce(F.col(s.time) > F.lag(s.time).over(by_time) + gap, F.lit(True)).cast("long"))
        rows = rows.withColumn("__session", F.sum("__first").over(by_time))
        rows = cut(rows.withColumn("__end", F.max(s.time).over(Window.partitionBy(*key, "__session")) + gap - F.expr("interval 1 millisecond")).drop("__first", "__session"))
        self._save(rows.where(F.col("__end") > F.lit(src.after)).drop("__end"), name)
        closed = (F.col("__end") > F.lit(src.before)) & (F.col("__end") <= F.lit(src.after))
        return Relation(self._sql(s.sql, **{s.source: rows.where(closed).drop("__end", "__seq")}), src.before, src.after)

    def _interval(self, name: str, s: dialect.Shape) -> Relation:
        """Pairs of which a row is new; for outer joins, also rows without a partner, once none can come any more."""
        left, right = self._of(s.source), self._of(s.right)
        lo, hi = _delta((s.lower or "").lstrip("-")) * (-1 if (s.lower or "").startswith("-") else 1), _delta((s.upper or "").lstrip("-")) * (-1 if (s.upper or "").startswith("-") else 1)
        reach = max(abs(lo), abs(hi))
        mark = min(left.after, right.after)
        new, old = F.lit(True), F.lit(False)

        def with_state(rows: DataFrame, state: str) -> DataFrame:
            rows, kept = rows.withColumns({"__new": new, "__matched": old}), self._state(state)
            return cut(rows if kept is None else rows.unionByName(kept.withColumn("__new", old)))

        lrows, rrows = with_state(left.rows, f"{name}l"), with_state(right.rows, f"{name}r")
        views = {s.source: lrows, s.right: rrows}
        out = self._sql(s.sql, **views)

        def told(rows: DataFrame, mine: tuple[str, str], other: tuple[str, str]) -> DataFrame:
            """rows, with __matched set where a partner is there now."""
            met, rest = (self._sql(f"SELECT {mine[1]}.* FROM `{mine[0]}` AS {mine[1]} LEFT {how} JOIN `{other[0]}` AS {other[1]} ON {s.partition[0]}", **views) for how in ("SEMI", "ANTI"))
            return cut(met.withColumn("__matched", new).unionByName(rest))

        l_past = F.col(s.time) + F.expr(f"interval {hi.total_seconds()} seconds") < F.lit(mark)
        r_past = F.col(s.right_time) - F.expr(f"interval {lo.total_seconds()} seconds") < F.lit(mark)
        ends = (s.source, s.alias), (s.right, s.right_alias)
        out = cut(out)
        if s.how in ("LEFT", "FULL"):
            lrows = told(lrows, *ends)
            out = out.unionByName(cut(self._sql(s.order, **{s.source: lrows.where(l_past & ~F.col("__matched")), s.right: rrows.limit(0)})))
        if s.how in ("RIGHT", "FULL"):
            rrows = told(rrows, *ends[::-1])
            out = out.unionByName(cut(self._sql(s.order, **{s.source: lrows.limit(0), s.right: rrows.where(r_past & ~F.col("__matched"))})))
        self._save(lrows.where(~l_past).drop("__new"), f"{name}l")
        self._save(rrows.where(~r_past).drop("__new"), f"{name}r")
        return Relation(cut(out), _less(min(left.before, right.before), reach), _less(mark, reach))

    def _temporal(self, name: str, s: dialect.Shape) -> Relation:
        left, right = self._of(s.source), self._of(s.right)
        vocab = next(i.vocab for i in self.request.inputs if i.alias == s.right)
        mark, time = min(left.after, right.after), vocab.event_time
        l_old, r_old = self._state(f"{name}l"), self._state(f"{name}r")
        probes = cut(left.rows if l_old is None else left.rows.unionByName(l_old))
        versions = cut(right.rows if r_old is None else right.rows.unionByName(r_old))
        shown = versions.drop(*{vocab.offset, vocab.op, vocab.system_time} - {k for _, k in s.keys})
        joined = asof_join(probes.where(F.col(s.time) <= F.lit(mark)), shown.where(F.col(time) <= F.lit(mark)), s.keys, s.time, time, s.right_alias, "__seq", s.outer)
        out = cut(self._with_seq(s.sql, f"{s.alias}.__seq", __asof=joined))
        self._save(probes.where(F.col(s.time) > F.lit(mark)), f"{name}l")
        last = versions.where(F.col(time) <= F.lit(mark))
        keep = last.groupBy(*[k for _, k in s.keys]).agg(F.max_by(F.struct("*"), F.struct(F.col(time), F.col("__seq"))).alias("__r")).select("__r.*")
        self._save(keep.unionByName(versions.where(F.col(time) > F.lit(mark))), f"{name}r")
        return Relation(out, min(left.before, right.before), mark)

    def _group(self, name: str, s: dialect.Shape) -> Relation:
        """Running aggregates as a changelog: each row appends or corrects its key's result, unless that stays as it was.
        The state is one row of partial values a key, put before the slice's rows; inputs are taken as appends."""
        src = self._of(s.source)
        if "__seq" not in src.rows.columns:
            src.rows = cut(src.rows.orderBy(*[c for c, t in src.rows.dtypes if not t.startswith("map")])).withColumn("__seq", F.monotonically_increasing_id())
        names = [f"`{k}`" for k in s.partition]
        rows = self._sql(f"SELECT {', '.join(['__seq', *names, *[f'({arg}) AS __x{i}' for i, (_, arg) in enumerate(s.calls)]])} {s.sql}")
        parts: dict[str, tuple] = {}  # column: how it is combined, what a row gives
        for i, (call, _) in enumerate(s.calls):
            x = F.col(f"__x{i}")
            if call != "count":
                parts[f"__p{i}"] = {"min": F.min, "max": F.max}.get(call, F.sum), x
            if call in ("count", "avg"):
                parts[f"__c{i}"] = F.sum, x.isNotNull().cast("long")
        types = rows.agg(F.lit(1).alias("__one"), *[how(x).alias(c) for c, (how, x) in parts.items()]).schema
        rows = rows.select("__seq", *names, *[x.cast(types[c].dataType).alias(c) for c, (_, x) in parts.items()])
        kept = self._state(name)
        rows = cut(rows if kept is None else rows.unionByName(kept.withColumn("__seq", F.lit(-1).cast("long"))))
        self._save(rows.groupBy(*names).agg(F.lit(1).alias("__one"), *[how(c).cast(types[c].dataType).alias(c) for c, (how, _) in parts.items()]).drop("__one"), name)
        by_seq = Window.partitionBy(*names).orderBy("__seq")
        running = rows.select("__seq", *names, *[how(c).over(by_seq.rowsBetween(Window.unboundedPreceding, 0)).cast(types[c].dataType).alias(c) for c, (how, _) in parts.items()])
        values = {"count": "__c{0}", "avg": "(__p{0} / nullif(__c{0}, 0))"}
        running = running.select("__seq", *names, *[F.expr(values.get(call, "__p{0}").format(i)).alias(f"__a{i}") for i, (call, _) in enumerate(s.calls)])
        running.createOrReplaceTempView("__running")
        shown = self.spark.sql(dialect.translate(f"SELECT {', '.join(names)}, __seq, named_struct({', '.join(_field(x) for x in s.items)}) AS __now FROM __running"))
        shown = shown.withColumn("__was", F.lag("__now").over(by_seq)).where(~F.col("__now").eqNullSafe(F.col("__was")) & (F.col("__seq") >= 0))
        change = lambda op, row, step: F.struct(F.lit(op).alias("__op"), F.lit(step).alias("__step"), F.col(row).alias("__row"))
        told = F.when(F.col("__was").isNull(), F.array(change(APPEND, "__now", 0))).otherwise(F.array(change(CORRECT_FROM, "__was", 0), change(CORRECT_TO, "__now", 1)))
        out = shown.select("__seq", F.explode(told).alias("__change")).select("__seq", "__change.__op", "__change.__step", "__change.__row.*")
        return Relation(cut(out), src.before, src.after)

    def _top(self, name: str, s: dialect.Shape) -> Relation:
        src = self._of(s.source)
        order = [(m[1].strip("`"), (m[2] or "").upper() == "DESC") for m in (re.fullmatch(r"\s*(?:\w+\.)?(`[^`]+`|\w+)(?:\s+(ASC|DESC))?\s*", x, re.I) for x in s.order.split(",")) if m]
        names = [c for c in src.rows.columns if c != "__seq"]
        found = cut(top_changes(src.rows.withColumn("__arrival", F.col("__seq")).drop("__seq"), order, s.n, "__arrival", s.partition, self._state(name)))
        self._save(found.where("__final").select(*names, "__arrival", "__place"), name)
        changes = found.where("not __final").withColumnRenamed("__op", "__kind")
        out = self._with_seq(re.sub(r"\(\s*SELECT\b", "(SELECT __kind, __seq, __step,", s.sql, count=1, flags=re.I) if re.search(r"\(\s*SELECT\b", s.sql, re.I) else s.sql, "__kind AS __op, __seq AS __seq1, __step AS __step1", **{s.source: changes})
        out = out.drop("__kind", "__seq", "__step").withColumnsRenamed({"__seq1": "__seq", "__step1": "__step"})
        return Relation(out, src.before, src.after)


def execute_transform(spark: SparkSession, request: TransformRequest) -> Success | Failure:
    """Runs a request: writes the new data (no file if there is none) and the checkpoint."""
    try:
        return _execute(spark, request)
    except (AnalysisException, ParseException, InvalidQueryError) as e:
        return Failure("InvalidQuery", str(e))
    except Exception as e:
        return Failure("InternalError", str(e), traceback.format_exc())


def _execute(spark: SparkSession, request: TransformRequest) -> Success:
    if request.transform.engine not in ENGINES:
        raise RuntimeError(f"Unsupported engine: {request.transform.engine}")
    run = Run(spark, request)
    run.load()
    out: Relation | None = None
    for k, s in enumerate(request.transform.steps):
        out = run.step(k, s.query)
        run.relations[s.alias or "__output__"] = out
        run._tap(s.alias or "__output__", out)
    v, rows = request.vocab, out.rows
    seen = [c for c in rows.columns if not c.startswith("__")]
    for c in (v.offset, v.system_time):
        if c in seen:
            raise ValueError(CLASH.format(c))
    if v.event_time not in seen:
        raise ValueError(NO_TIME.format(v.event_time, ", ".join(seen)))
    op = F.col(v.op).cast("int") if v.op in seen else F.col("__op").cast("int") if "__op" in rows.columns else F.lit(0)
    order = [c for c in ("__seq", "__step") if c in rows.columns]
    if "__seq" not in order:
        order += [v.event_time, *[f.name for f in rows.schema.fields if f.name in seen and f.name != v.event_time and f.dataType.typeName() not in ("map", "variant")]]
    numbered, n = with_offsets(rows, [F.col(f"`{c}`") for c in order], request.next_offset, "__offset")
    named = numbered.select(
        F.coalesce(F.col("__offset"), F.lit(0).cast("long")).alias(v.offset), F.coalesce(op, F.lit(0)).alias(v.op), F.lit(request.system_time).cast("timestamp").alias(v.system_time), *[F.col(f"`{c}`") for c in seen if c != v.op]
    )
    if n:
        write_file(named, request.data_path)
    run._count("output", n)
    save_json(spark, f"{request.checkpoint}/_state", run.now)
    return Success((request.next_offset, request.next_offset + n - 1) if n else None, out.after if out.after > _EVER else None)
