"""Raw queries: one bounded pass over files, seen as `input`."""

from __future__ import annotations

import re
import traceback

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tidewright.dialect import shape, snapshots, translate
from tidewright.model import ENGINES, Failure, InvalidQueryError, RawQueryRequest, Success, Vocab
from tidewright.operators import asof_join
from tidewright.session import cut
from tidewright.sinks import write_file
from tidewright.sources.slices import nanosecond_columns, utc


def _query(spark: SparkSession, text: str, temporal: dict[str, list[str]]) -> DataFrame:
    """A step, which may join a temporal table: a view with a primary key and the default vocabulary's event time."""
    text = snapshots(text, temporal, {})
    if not re.search(r"\bLATERAL\s+TABLE\b|\bFOR\s+SYSTEM_TIME\b", text, re.I):
        return spark.sql(translate(text))
    s, v = shape(text, temporal), Vocab()
    versions = spark.table(f"`{s.right}`")
    tie = v.offset if v.offset in versions.columns else None
    asof_join(spark.table(f"`{s.source}`"), versions, s.keys, s.time, v.event_time, s.right_alias, tie, s.outer).createOrReplaceTempView("__asof")
    return spark.sql(translate(s.sql))


def execute_raw_query(spark: SparkSession, request: RawQueryRequest) -> Success | Failure:
    """Writes the result to one file, none if it is empty."""
    try:
        if request.transform.engine not in ENGINES:
            raise RuntimeError(f"Unsupported engine: {request.transform.engine}")
        schema = spark.read.parquet(request.paths[0]).schema
        utc(spark.read.schema(schema).parquet(*request.paths), nanosecond_columns(spark, request.paths[0])).createOrReplaceTempView("input")
        out = None
        for step in request.transform.steps:
            out = _query(spark, step.query, request.transform.temporal)
            out.createOrReplaceTempView(f"`{step.alias or '__output__'}`")
        out = cut(out)
        n = out.count()
        if n:
            write_file(utc(out), request.output)
        return Success(num_records=n)
    except (AnalysisException, ParseException, InvalidQueryError) as e:
        return Failure("InvalidQuery", str(e))
    except Exception as e:
        return Failure("InternalError", str(e), traceback.format_exc())
