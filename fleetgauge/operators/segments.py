"""Ordered computations inside groups of any size.

A plain window partitioned by the group sorts a whole group in one task.  Here a group is
cut into segments along its order, the window runs per (group, segment), and what crosses
a segment border (last row, running total) is taken from a small table with one row per
segment.  Results equal those of the plain window; a group holding a third of all rows is
spread over as many tasks as it has segments.

``segment`` must not decrease along the order, e.g. ``floor(time / width)``.  Null keys form a
group, and rows with a null order value come first, as in a plain window; their segment is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"


def by_width(order: Column, width: float | int) -> Column:
    """Segment number of an ordering value for a fixed segment width."""
    return F.floor(order / F.lit(width)).cast("long")


def segmented(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn(SEGMENT, segment)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the other columns must differ in name."""
    renamed = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(renamed[f"_on_{key}"])
    return left.join(renamed, match, how).drop(*[f"_on_{k}" for k in keys])


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by (keys, segment) ahead of a window over them.

    Data that a join left partitioned by the keys alone would satisfy such a window as it is,
    and a hot key would stay in one task; stating the partitioning rules that out.  Where no
    join came before, it is the shuffle the window needs anyway.
    """
    return df.repartition(*keys, SEGMENT)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    segment: Column,
    out: str = "previous",
    where: Column | None = None,
) -> DataFrame:
    """Add struct ``out`` with ``values`` of the preceding row of the group (null on the first).

    With ``where`` only rows that satisfy it count as preceding rows.
    """
    held = F.struct(*values) if where is None else F.when(where, F.struct(*values))
    data = segmented(df, segment).withColumn("_held", held)
    local = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    if where is None:
        here, carry = F.lag("_held").over(local), F.lag("_tail").over(across)
    else:
        span = (Window.unboundedPreceding, -1)
        here = F.last("_held", ignorenulls=True).over(local.rowsBetween(*span))
        carry = F.last("_tail", ignorenulls=True).over(across.rowsBetween(*span))
    place = F.when(F.col("_held").isNotNull(), F.struct(*order))
    tails = data.groupBy(*keys, SEGMENT).agg(F.max_by("_held", place).alias("_tail"))
    carried = tails.select(*keys, SEGMENT, carry.alias("_carried"))
    return (
        join_on(spread(data, keys).withColumn(out, here), carried, [*keys, SEGMENT])
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_carried", "_held", SEGMENT)
    )


_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    inclusive: bool = True,
    **aggregates: tuple[str, str],
) -> DataFrame:
    """Running ``sum``/``count``/``max``/``min`` columns, ``out=(kind, column)``.

    ``inclusive=False`` looks only at the rows before the current one (null where none are).
    """
    data = segmented(df, segment)
    stop = 0 if inclusive else -1
    local = (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, stop)
    )
    totals = data.groupBy(*keys, SEGMENT).agg(
        *[_AGGREGATE[kind](column).alias(f"_t_{out}") for out, (kind, column) in aggregates.items()]
    )
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        SEGMENT,
        *[
            _COMBINE[kind](f"_t_{out}").over(before).alias(f"_c_{out}")
            for out, (kind, _) in aggregates.items()
        ],
    )
    result = join_on(spread(data, keys).withColumns(
        {out: _AGGREGATE[kind](column).over(local) for out, (kind, column) in aggregates.items()}
    ), carried, [*keys, SEGMENT])
    return result.withColumns(
        {out: _merge(kind, F.col(f"_c_{out}"), F.col(out)) for out, (kind, _) in aggregates.items()}
    ).drop(SEGMENT, *[f"_c_{out}" for out in aggregates])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    out: str = "position",
) -> DataFrame:
    """1-based position in the group without sorting the group in one task."""
    numbered = running(df.withColumn("_one", F.lit(1)), keys, order, segment, **{out: ("count", "_one")})
    return numbered.drop("_one")


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    size: int,
    segment_rows: int = 100_000,
    out: str = "moving_mean",
    kind: str = "mean",
) -> DataFrame:
    """Mean or ``max`` of the last ``size`` rows by a dense 1-based ``index``.

    Each segment takes a copy of the ``size - 1`` rows before it, so no group is sorted whole.  A
    row without an index has no value.
    """
    reduce = {"mean": F.avg, "max": F.max}[kind]
    rows = max(segment_rows, size)
    own = F.floor((F.col(index) - 1) / rows).cast("long")
    later = F.floor((F.col(index) - 1 + size - 1) / rows).cast("long")
    copies = df.withColumn("_own", own).withColumn(SEGMENT, F.explode_outer(F.sequence(own, later)))
    window = Window.partitionBy(*keys, SEGMENT).orderBy(index).rowsBetween(-(size - 1), 0)
    return (
        spread(copies, keys).withColumn(out, F.when(F.col("_own").isNotNull(), reduce(value).over(window)))
        .filter(F.col("_own").eqNullSafe(F.col(SEGMENT)))
        .drop("_own", SEGMENT)
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    count: int,
    segment: Column,
) -> DataFrame:
    """The first ``count`` rows of each group, for any ``count``.

    Row counts per segment say which segments the first rows reach into; the others are left out
    before anything is sorted, and each segment that stays is numbered on its own.
    """
    data = segmented(df, segment)
    sizes = data.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    reached = sizes.select(*keys, SEGMENT, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")).filter(F.col("_before") < count)
    local = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    placed = spread(join_on(data, reached, [*keys, SEGMENT]), keys).withColumn("_place", F.col("_before") + F.row_number().over(local))
    return placed.filter(F.col("_place") <= count).drop(SEGMENT, "_before", "_place")


SALTS = 64


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], count: int, out: str = "rank") -> DataFrame:
    """The ``count`` best rows of each group, numbered from 1, for counts that one task can sort ``SALTS`` times over.

    Each group is first dealt into ``SALTS`` parts by a hash of its rows, every part keeps its
    own best, and only those meet.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if "map" not in dict(df.dtypes)[c]]), F.lit(SALTS))
    dealt = df.withColumn(SEGMENT, part)
    local = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    kept = spread(dealt, keys).withColumn(out, F.row_number().over(local)).filter(F.col(out) <= count).drop(out, SEGMENT)
    # Stated, so that the parts meet by key and are not taken as they lie.
    met = kept.repartition(*keys) if keys else kept
    return met.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= count)
