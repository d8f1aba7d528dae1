"""Ordered rules: monotone stamps, gaps, checkpoints, moving rates, rotation and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators.segments import SEGMENT, by_width, first_rows, previous_row, row_numbers, spread, trailing

# Rows of one group that a single task may have to order.
SEGMENT_ROWS = 100_000
# Implementations 0, 1, 2 in the order of each round.
ROUND_ORDERS = {1: (0, 1, 2), 2: (1, 2, 0), 3: (2, 0, 1), 4: (2, 1, 0), 5: (0, 2, 1)}
IDLE_TOLERANCE_SECONDS = 0.05


def strictly_increasing(
    df: DataFrame, keys: Sequence[str], index: str, value: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Per group: whether ``value`` grows at every row, and the first index where it does not."""
    here = F.struct(F.col(index).alias("i"), F.col(value).alias("v"))
    data = df.select(*keys, index, value, by_width(F.col(index), segment_rows).alias(SEGMENT), here.alias("_row"))
    local = Window.partitionBy(*keys, SEGMENT).orderBy(index)
    bad = F.col(value).isNull() | (F.col(value) <= F.lag(value).over(local))
    # One row per segment: its first bad index, its first and its last row.
    parts = spread(data, keys).withColumn("_bad", F.when(bad, F.col(index))).groupBy(*keys, SEGMENT).agg(
        F.min("_bad").alias("_bad"), F.min("_row").alias("_head"), F.max("_row").alias("_tail"))
    before = F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SEGMENT))
    joint = F.when(F.col("_head.v") <= before["v"], F.col("_head.i"))
    return parts.withColumn("_joint", joint).groupBy(*keys).agg(
        F.least(F.min("_bad"), F.min("_joint")).alias("bad_index")
    ).withColumn("monotonic", F.col("bad_index").isNull())


def keyframe_gaps(
    df: DataFrame, keys: Sequence[str], index: str, keyframe: Column, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """One row per keyframe with its distance to the keyframe before it (null on the first)."""
    marked = df.filter(keyframe).select(*keys, index)
    seen = previous_row(marked, keys, [index], [index], by_width(F.col(index), segment_rows))
    return seen.select(*keys, index, (F.col(index) - F.col(f"previous.{index}")).alias("gap"))


def contiguous(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Whether the indexes of a group are exactly 1..n, by counts alone."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        ((F.min(index) == 1) & (F.max(index) == F.count("*")) & (F.count_distinct(index) == F.count("*"))).alias(
            "contiguous"
        ),
    )


def complete_rounds(df: DataFrame, keys: Sequence[str], round_column: str, member: str, expected: int) -> DataFrame:
    """Complete rounds per group; rounds must not be interrupted by a missing or partial one."""
    members = df.groupBy(*keys, round_column).agg(F.count_distinct(member).alias("_m"))
    whole = F.col("_m") == expected
    return members.groupBy(*keys).agg(
        F.count_if(whole).alias("complete_rounds"),
        (F.max(round_column) == F.count_if(whole)).alias("contiguous"),
    )


def idle_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    started_us: str,
    finished_us: str,
    required_seconds: float,
    segment: Column,
) -> DataFrame:
    """Seconds since the previous step of the group finished, with the ordered ``errors``."""
    seen = previous_row(df, keys, order, [finished_us], segment)
    gap = (F.col(started_us) - F.col(f"previous.{finished_us}")) / 1e6
    least = max(0.0, required_seconds - IDLE_TOLERANCE_SECONDS)
    return seen.withColumns({
        "idle_seconds": gap,
        "errors": R.labels([
            ("finishes before it starts", F.col(finished_us) < F.col(started_us)),
            (f"did not observe the required {required_seconds:g}s idle interval", gap < least),
        ]),
    }).drop("previous")


def phase_intervals(
    df: DataFrame, keys: Sequence[str], name: str, stamp: str, start: str, finish: str, width: int
) -> DataFrame:
    """Named gaps ``a_to_b`` between checkpoints ordered by (time, name); seconds from ns or us.

    ``start`` and ``finish`` bound the process; checkpoints outside are flagged.
    """
    seen = previous_row(df, keys, [stamp, name], [name, stamp], by_width(F.col(stamp), width))
    return seen.filter(F.col("previous").isNotNull()).select(
        *keys,
        F.concat_ws("_to_", F.col(f"previous.{name}"), F.col(name)).alias("interval"),
        (F.col(stamp) - F.col(f"previous.{stamp}")).alias("length"),
        ((F.col(stamp) < F.col(start)) | (F.col(stamp) > F.col(finish))).alias("outside"),
    )


def moving_rate(df: DataFrame, keys: Sequence[str], index: str, seconds: str, size: int) -> DataFrame:
    """Mean of the last ``size`` frame times and its rate, at the first and every ``size``-th frame."""
    means = trailing(df, keys, index, seconds, size, SEGMENT_ROWS, "mean_seconds")
    return means.filter((F.col(index) % size == 0) | (F.col(index) == 1)).withColumn(
        "fps", F.when(F.col("mean_seconds") > 0, 1.0 / F.col("mean_seconds")).otherwise(0.0)
    )


def rotation_order(campaigns: DataFrame, implementations: Sequence[str], rounds: int) -> DataFrame:
    """Expected steps (sequence, round, implementation) of every campaign."""
    if rounds not in (3, 5):
        raise ValueError("a campaign has 3 or 5 rounds")
    steps, number = [], 0
    for round_index in range(1, rounds + 1):
        for slot in ROUND_ORDERS[round_index]:
            number += 1
            steps.append(F.struct(
                F.lit(number).alias("sequence_index"), F.lit(round_index).alias("round_index"),
                F.lit(implementations[slot]).alias("implementation"),
            ))
    return campaigns.select("*", F.inline(F.array(*steps)))


def align_sequence(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
    position: str, compare: Sequence[str],
) -> DataFrame:
    """Match the n-th actual step with the n-th expected one and name the fields that differ."""
    numbered = row_numbers(actual, keys, order, segment, position)
    ours = numbered.select(*keys, position, F.struct(*compare).alias("_a"))
    theirs = expected.select(*keys, F.col(position).cast("long").alias(position), F.struct(*compare).alias("_e"))
    both = ours.join(theirs, [*keys, position], "full")
    present = F.col("_a").isNotNull() & F.col("_e").isNotNull()
    rules = [("missing step", F.col("_a").isNull()), ("too many steps", F.col("_e").isNull())]
    rules += [(f"changed {f}", present & R.differs(F.col(f"_a.{f}"), F.col(f"_e.{f}"))) for f in compare]
    return both.select(*keys, position, R.labels(rules).alias("errors"))


def rebase_time(samples: DataFrame, origins: DataFrame, keys: Sequence[str], stamp: str, origin: str, out: str) -> DataFrame:
    """Shift sample clocks to the origin of their run."""
    return samples.join(origins.select(*keys, origin), list(keys)).withColumn(out, F.col(stamp) - F.col(origin)).drop(origin)


def resample_drop(df: DataFrame, keys: Sequence[str], seconds: Column, source_fps: float, target_fps: float) -> DataFrame:
    """Frames kept when dropping to a lower rate: the last frame of each nearest target slot."""
    if source_fps < target_fps:
        raise ValueError("dropping frames cannot raise the rate")
    slot = F.floor(seconds * target_fps + 0.5).cast("long")
    held = [f for f in df.columns if f not in keys]
    return (
        df.withColumns({"_slot": slot, "_at": seconds})
        .groupBy(*keys, F.col("_slot").alias("slot"))
        .agg(F.max_by(F.struct(*held), F.struct("_at", *held)).alias("_kept"))
        .select(*keys, "slot", "_kept.*")
    )


def limit_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """First ``count`` frames per file, all when ``count`` is 0; the first of ``order`` is a number."""
    if count <= 0:
        return df
    return first_rows(df, keys, order, count, by_width(F.col(order[0]), segment_rows))
