"""Exact order statistics of groups of any size by radix selection.

A first pass counts values per group and segment, a grid over the exponent and leading mantissa
bits (64 steps per power of two), with the least and largest value of each segment.  Running
counts over that small table say which segment holds a wanted rank, and a rank at either end of
it is answered by its least or largest value.  What is still open is refined: only values inside
the open segments are counted again, each segment cut into 4,096 equal steps between its least
and largest value, until every rank is answered.  A double has 52 mantissa bits, so six passes
end any input, and near-constant values take one or two.

No value is shuffled: every pass combines to bucket counts map-side, and no group is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators.segments import join_on
from fleetgauge.session import written

STEPS = 64           # value segments per power of two
ORIGIN = 1100 * 64   # more than the steps between 1 and the smallest double
FANOUT = 4096        # steps of a refinement
# Open segments of at most this many rows travel to every task; beyond, they are joined by shuffle.
SENT_ROWS = 100_000


def value_segment(value: Column) -> Column:
    """Segment number that never falls as the value grows; null for null, NaN last."""
    # log2 of a double lies in [-1074, 1024]; the least() keeps infinity on the grid.
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * STEPS) + ORIGIN
    return F.when(value.isNull(), F.lit(None)).when(F.isnan(value), F.lit(4 * ORIGIN)).when(value == 0, F.lit(0)).otherwise(
        F.when(value < 0, -size).otherwise(size)).cast("long")


def _step(value: Column, low: Column, high: Column) -> Column:
    """Step of a refinement; rounding keeps the order, so steps never fall as values grow."""
    return F.when(high > low, F.least(F.floor((value - low) / (high - low) * FANOUT), F.lit(FANOUT - 1))).otherwise(F.lit(0)).cast("long")


def _located(counted: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Wanted ranks that fall into each bucket, with the number of values before it."""
    earlier = F.sum("_k").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_before", F.col("_start") + F.coalesce(earlier, F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_k")))
    return placed.withColumn("_ranks", inside).filter(F.size("_ranks") > 0)


def values_at_ranks(values: DataFrame, keys: Sequence[str], ranks: Column) -> tuple[DataFrame, DataFrame]:
    """Values (double) at given ranks of each (keys, ``_m``) group of ``values`` (keys, ``_m``, ``_v``).

    ``ranks`` is an array of (slot, rank) structs over ``_m`` and the number ``_n`` of non-null
    values; rank 0 is the smallest value, NaN the largest.  Returns (keys, _m, slot, value) and
    the groups (keys, _m, _n), those without a value included.
    """
    group, levels = [*keys, "_m"], ["_b0"]
    gridded = values.withColumn("_b0", value_segment(F.col("_v")))
    facts = [F.count("_v").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    counted = gridded.groupBy(*group, "_b0").agg(*facts)
    counted = written(counted.select("*", F.sum("_k").over(Window.partitionBy(*group)).alias("_n")), "counted")
    groups = counted.groupBy(*group).agg(F.max("_n").alias("_n"))
    found = _located(counted.withColumns({"_ranks": ranks, "_start": F.lit(0).cast("long")}).filter("_k > 0"), group, "_b0")
    answers = None
    while True:
        found = written(found.select(*group, *levels, "_low", "_high", "_k", "_before", "_ranks"), "ranked")
        at_low = lambda r: (F.col("_low") == F.col("_high")) | (r["rank"] == F.col("_before"))
        ends = lambda r: at_low(r) | (r["rank"] == F.col("_before") + F.col("_k") - 1)
        told = F.explode(F.transform(F.filter("_ranks", ends), lambda r: F.struct(
            r["slot"].alias("slot"), F.when(at_low(r), F.col("_low")).otherwise(F.col("_high")).alias("value"))))
        told = found.select(*group, told.alias("_r")).select(*group, "_r.slot", "_r.value")
        answers = told if answers is None else answers.unionByName(told)
        still = found.withColumn("_ranks", F.filter("_ranks", lambda r: ~ends(r))).filter(F.size("_ranks") > 0)
        size = still.count()
        if not size:
            return answers, groups
        opened = still.select(*group, *levels, "_low", "_high", F.col("_before").alias("_start"), "_ranks")
        level = f"_b{len(levels)}"
        gridded = join_on(gridded, F.broadcast(opened) if size <= SENT_ROWS else opened, [*group, *levels]).withColumn(
            level, _step(F.col("_v"), F.col("_low"), F.col("_high")))
        counted = gridded.groupBy(*group, *levels, level).agg(*facts, F.first("_start").alias("_start"), F.first("_ranks").alias("_ranks"))
        found = _located(counted, [*group, *levels], level)
        gridded = gridded.drop("_low", "_high", "_start", "_ranks")
        levels.append(level)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, tuple[str, float]],
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per key with ``alias -> quantile(column, q)``; ``counts`` adds non-null counts.

    Nulls are skipped; a group with nothing but nulls has null quantiles; null keys form a group.
    A quantile at rank r = q * (n - 1) is interpolated linearly between its neighbours.
    """
    counts = counts or {}
    sources = sorted({column for column, _ in metrics.values()} | set(counts.values()))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in sources]))
    values = df.select(*keys, each.alias("_e")).select(*keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"))
    last = F.col("_n") - 1
    wanted = F.lit(None).cast("array<struct<slot:int,rank:bigint>>")
    for source in sources:
        own = [(n, q) for n, (column, q) in enumerate(metrics.values()) if column == source]
        if own:
            entry = lambda slot, rank: F.struct(F.lit(slot).alias("slot"), rank.cast("long").alias("rank"))
            wanted = F.when(F.col("_m") == source, F.array(*[
                e for n, q in own for e in (entry(2 * n, F.floor(last * float(q))), entry(2 * n + 1, F.ceil(last * float(q))))])).otherwise(wanted)
    answers, groups = values_at_ranks(values, keys, wanted)
    slot = lambda n: F.max(F.when(F.col("slot") == n, F.col("value")))
    found = [slot(2 * n + side).alias(f"_{name}_{alias}") for n, alias in enumerate(metrics) for side, name in enumerate(("lo", "hi"))]
    ends = answers.groupBy(*keys).agg(*found)
    sizes = [F.max(F.when(F.col("_m") == column, F.col("_n"))).alias(f"_n_{column}") for column in sources]
    both = join_on(groups.groupBy(*keys).agg(*sizes), ends, keys, "left") if keys else groups.agg(*sizes).join(ends, F.lit(True), "left")

    def between(alias: str, column: str, q: float) -> Column:
        low, high = F.col(f"_lo_{alias}"), F.col(f"_hi_{alias}")
        rank = (F.col(f"_n_{column}") - 1) * float(q)
        # Equal neighbours need no arithmetic, which infinite ones could not stand.
        return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank))).alias(alias)

    return both.select(
        *keys, *[F.col(f"_n_{column}").alias(alias) for alias, column in counts.items()],
        *[between(alias, column, q) for alias, (column, q) in metrics.items()])
