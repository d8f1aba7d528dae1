"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.storage import saved

MAX_ROUNDS = 60


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def near_labels(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """id, label: the smallest id within ``rounds`` steps; equal labels are connected, the converse need not hold."""
    pairs = both_ways(edges)
    labels = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label")
    for _ in range(rounds - 1):
        best = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        labels = labels.join(best, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("label"))
    return saved(labels, "near-labels")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) for every id in ``edges`` (a, b), by alternating star operations.

    A large star links the larger neighbours of a node to its smallest one, a small star the
    smaller ones; both keep connectivity, and the edges end as one star per component.  The
    number of rounds grows with the logarithm of the longest path.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        pairs = both_ways(now)
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = pairs.join(low, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = saved(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        # Converged when every node has one edge and no target is itself a source.
        change = now.exceptAll(after).limit(1).count() + after.exceptAll(now).limit(1).count()
        now = after
        if not change:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
