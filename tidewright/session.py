"""Session settings that the engine's results rely on, and where it keeps intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What result types, names and times need.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MILLIS",
    "spark.sql.parquet.binaryAsString": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.caseSensitive": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tidewright", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS. `more`: further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and all runs in this process, as in
    tests, a temporary one; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept reliably in the shared folder, so that lost executors cost no recomputation. Spark
    removes the files of tables that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpoint keeps its plan's size estimate, and a join's is the product of its sides: in a loop its digits would
    double with each round. So the plan is made anew over the kept rows, with their partitioning and without the estimate."""
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    plan, jvm = kept._jdf.queryExecution().analyzed(), spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
