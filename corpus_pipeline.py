"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes what the one before kept, as Parquet, and all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm.decontamination import decontaminate
from fleetgauge.llm.jaccard import keep_one
from fleetgauge.llm.mixing import mix_documents
from fleetgauge.llm.quality import keep_good
from fleetgauge.llm.sharding import shard_documents
from fleetgauge.llm.storage import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; rows with a null id, language or source are judged like others
    (null is a value of its own); equal texts of one language and source share their verdict.
    """
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 85 % of shared four-word shingles.

    The smallest id stays, nulls last; of equal rows one.  Rows without words all stay.  An id that
    several texts share loses only those texts that have a representative.
    """
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows.

    Null and empty texts stay, and so does everything where the benchmark is empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    A null source is a source of its own, null texts have size 0, and equal rows are taken alike.
    """
    return mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot.

    Equal texts share a shard, null texts another; repeated rows and null ids have slots of their own.
    """
    return shard_documents(docs)


STAGES = [
    ("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage), ("sharding", sharding_stage)]

# SQL has no minimum-covariance-determinant estimate and no 64-bit hash that both engines share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that the stages keep, as often as the mix takes it.

    Nulls and repeated rows are treated as each stage states; columns beside those of ``documents``
    travel along under any name; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = saved(docs, f"stage-{number}")
    return docs
