"""Sinks: deterministic JSON, appends, create-once and checked publication."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PublicationError(RuntimeError):
    """Staged output did not pass its checks."""


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in order; a row that holds NaN or infinity fails the job."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    for name in numbers:
        bad = F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
        text = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{name} is not finite"))).otherwise(text)
    return df.withColumn("value", text)


def write_sorted_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a fixed order with sorted keys; every line ends with one newline.

    The range-partitioned sort writes ordered part files, so nothing is gathered in one task.
    """
    sorted_json(df).orderBy(*order).select("value").write.mode("errorifexists").text(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append finished steps to an event log."""
    df.write.mode("append").json(path)


def create_exclusive(df: DataFrame, path: str) -> None:
    """Create a dataset; an existing one is an error and stays as it is."""
    df.write.mode("errorifexists").parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """Numbers of all publications and their pointer files, the newest first."""
    of, fs = _hadoop(spark, target)
    folder = of(f"{target}/{POINTERS}")
    found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(((int(p.getName()), p.toString()) for p in found if p.getName().isdigit()), reverse=True)


VERSIONS, POINTERS = "_versions", "_pointers"


def publish_atomically(df: DataFrame, path: str, checks: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> int:
    """Write a new version below ``path``, check what was written, then point to it; returns its number.

    A check returns the offending rows.  Versions are folders of their own and never change; a
    publication becomes visible through one small file named by its number, which the store
    creates only if no other writer has.  So a reader always finds a whole version, and of two
    writers one wins and the other raises ``PublicationError``; its version, like one that
    failed a check, stays for inspection.  Readers use ``read_published``.
    """
    spark: SparkSession = df.sparkSession
    target = path.rstrip("/")
    number = max((n for n, _ in _pointers(spark, target)), default=0) + 1
    version = f"{VERSIONS}/{number:012d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{target}/{version}")
    staged = spark.read.parquet(f"{target}/{version}")
    failed = [label for label, offending in checks if not offending(staged).isEmpty()]
    if failed:
        raise PublicationError(f"staged output failed: {', '.join(failed)}")
    of, fs = _hadoop(spark, target)
    pointer = of(f"{target}/{POINTERS}/{number:012d}")
    try:
        stream = fs.create(pointer, False)
    except Py4JJavaError as error:
        raise PublicationError(f"another writer published number {number} of {target}") from error
    try:
        stream.write(bytearray(f"{version}\n".encode()))
    finally:
        stream.close()
    return number


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole publication of ``path``; without one, ``FileNotFoundError``."""
    target = path.rstrip("/")
    of, fs = _hadoop(spark, target)
    for _, pointer in _pointers(spark, target):
        stream = fs.open(of(pointer))
        try:
            version = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        # A pointer that is still being written is not published yet.
        if version.endswith("\n"):
            return spark.read.parquet(f"{target}/{version.strip()}")
    raise FileNotFoundError(f"nothing is published at {target}")
