"""The corpus pipeline: five stages that make training sequences of the table documents.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; it is written as Parquet in the shared folder and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from tidewright.llm.common import free_names
from tidewright.session import delete, shared_folder
from tidewright.sources import table


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    (name,) = free_names(docs, "quality")
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more), the row with the smallest id."""
    return jaccard_join.keep_one(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_matching(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences."""
    return packing.pack(packing.pieces(docs, packing.default_tokenizer()))


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, over documents."""
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage after it has read is not needed any more
            delete(spark, before)
        before = path
    return docs
