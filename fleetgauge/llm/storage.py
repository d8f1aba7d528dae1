"""Tables kept in the folder that all executors share, and what tasks hold of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.session import new_folder

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Rows reach the Python workers in Arrow batches of about ``BATCH_BYTES`` (one longer row stands alone).

    Ten thousand rows, Spark's own limit, are tens of megabytes of text, held outside the heap by the
    executor and again by the worker, by every running task.  A limit that the session sets stays.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
