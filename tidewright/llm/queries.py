"""The queries that apply the operators to the example tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Modules with NAME, query(spark, folder) and, where SQL can express it, ORACLE.
MODULES = ["quality", "url_filter", "packing", "language_model", "exact_dedup", "jaccard_join", "line_dedup", "langid", "decontaminate", "warc"]

for _name in MODULES:
    _module = importlib.import_module(f"tidewright.llm.{_name}")
    QUERIES[_module.NAME] = _module.query
    if getattr(_module, "ORACLE", None):
        ORACLES[_module.NAME] = _module.ORACLE
