"""Registry of runnable queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import use_utc

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        use_utc(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **types: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``types`` names SQL result types that literals and counts in the SQL do not give by themselves.
    """
    if sql is not None and types:
        casts = ", ".join(f'CAST("{column}" AS {kind}) AS "{column}"' for column, kind in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def wrap(fn):
        def build(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql)
        return fn

    return wrap


def micros(column: str = "ts"):
    """Microseconds since 1970 of a naive (UTC) timestamp column."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round double columns so that summation order cannot show; ``+ 0.0`` removes -0.0."""
    chosen = names or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in chosen})
