"""Half-open integer intervals: merging, coverage, overlap and trace findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators.segments import SEGMENT, by_width, join_on, spread


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Cut intervals to a window; what falls outside is dropped before any join or shuffle."""
    return (
        df.filter((F.col(end) > low) & (F.col(start) < high))
        .withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})
        .filter(F.col(end) > F.col(start))
    )


def merge_intervals(
    df: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """Merge overlapping or touching intervals per key; empty ones vanish.

    Intervals are merged inside time segments of ``width`` first.  Two numbers per segment, its
    last start and its furthest end, then tell how far earlier segments reach and where their
    last island began.  A piece within that reach belongs to that island, any other piece
    begins its own.
    """
    data = df.select(*keys, start, end).filter(F.col(end) > F.col(start))
    data = data.withColumn(SEGMENT, by_width(F.col(start), width))
    local = Window.partitionBy(*keys, SEGMENT).orderBy(start, end)
    reach = F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1))
    pieces = (
        spread(data, keys).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
        .withColumn("_piece", F.max("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, SEGMENT, "_piece")
        .agg(F.max(end).alias(end))
    )
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        pieces.groupBy(*keys, SEGMENT)
        .agg(F.max("_piece").alias("_last"), F.max(end).alias("_end"))
        .withColumn("_reach", F.max("_end").over(earlier))
        .withColumn("_opened", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last")))
        .withColumn("_island", F.max("_opened").over(earlier))
        .select(*keys, SEGMENT, "_reach", "_island")
    )
    own = F.col("_reach").isNull() | (F.col("_piece") > F.col("_reach"))
    return (
        pieces.join(reached, [*keys, SEGMENT])
        .withColumn("_island", F.when(own, F.col("_piece")).otherwise(F.col("_island")))
        .groupBy(*keys, "_island")
        .agg(F.max(end).alias(end))
        .select(*keys, F.col("_island").alias(start), end)
    )


def sweep_states(
    df: DataFrame, keys: Sequence[str], sides: dict[str, Column], width: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """How long each combination of open-interval counts lasted: keys, one count per side, ``span``.

    ``sides`` says by a condition which intervals belong to a side.  Interval ends become +1/-1
    edges, shuffled once by (key, time segment).  Inside a segment the counts are known up to
    what earlier segments left open, so time is summed per relative level, and the level
    carried in comes from a table with one row per segment.  No interval join.
    """
    names = list(sides)
    data = df.filter(F.col(end) > F.col(start)).withColumns({f"_in_{n}": side.cast("int") for n, side in sides.items()})
    edges = data.select(
        *keys,
        *[f"_in_{n}" for n in names],
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("_e"),
    ).select(
        *keys, by_width(F.col("_e.t"), width).alias(SEGMENT), F.col("_e.t").alias("_t"),
        *[(F.col("_e.d") * F.col(f"_in_{n}")).alias(f"_d_{n}") for n in names])
    changes = [F.sum(f"_d_{n}").alias(f"_d_{n}") for n in names]
    instants = spread(edges, keys).groupBy(*keys, SEGMENT, "_t").agg(*changes)
    local = Window.partitionBy(*keys, SEGMENT).orderBy("_t")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n, window: F.coalesce(F.sum(f"_d_{n}").over(window), F.lit(0))
    levels = instants.withColumns({
        **{f"_l_{n}": total(n, before) for n in names}, "_span": F.col("_t") - F.lag("_t").over(local),
    }).groupBy(*keys, SEGMENT, *[f"_l_{n}" for n in names]).agg(F.sum("_span").alias("_span"))
    # Combined map-side from the edges: one row per segment is shuffled here.
    carried = edges.groupBy(*keys, SEGMENT).agg(*changes, F.min("_t").alias("_from"), F.max("_t").alias("_to")).select(
        *keys, SEGMENT, *[total(n, earlier).alias(f"_c_{n}") for n in names],
        (F.col("_from") - F.max("_to").over(earlier)).alias("_rest"))
    # Every segment starts at relative level zero; the time since the last instant of the
    # segment before it was spent at that level too.
    opening = F.lit(True)
    for n in names:
        opening = opening & (F.col(f"_l_{n}") == 0)
    return levels.join(carried, [*keys, SEGMENT]).select(
        *keys, *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in names],
        (F.coalesce("_span", F.lit(0)) + F.coalesce(F.when(opening, F.col("_rest")), F.lit(0))).alias("span"))


def busy_time(condition: Column) -> Column:
    """Sum of the spans of ``sweep_states`` in which the condition holds."""
    return F.coalesce(F.sum(F.when(condition, F.col("span"))), F.lit(0)).cast("long")


def concurrency_sweep(
    df: DataFrame, keys: Sequence[str], side: Column, width: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """Busy time of side A (``side`` true), of side B, and of both at once, per key."""
    states = sweep_states(df, keys, {"_a": side, "_b": ~side}, width, start, end)
    on_a, on_b = F.col("_a") > 0, F.col("_b") > 0
    return states.groupBy(*keys).agg(
        busy_time(on_a).alias("busy_a"), busy_time(on_b).alias("busy_b"), busy_time(on_a & on_b).alias("overlap"))


def interval_overlap(
    left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """Total time during which both interval sets of a key are busy."""
    both = left.select(*keys, start, end, F.lit(True).alias("_left")).unionByName(
        right.select(*keys, start, end, F.lit(False).alias("_left"))
    )
    return concurrency_sweep(both, keys, F.col("_left"), width, start, end).select(*keys, "overlap")


def interval_coverage(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], width: int
) -> DataFrame:
    """Merged busy time as percent of one window (``win_start``, ``win_end``) per key."""
    inside = clip(df.join(windows, list(keys)), F.col("win_start"), F.col("win_end"))
    busy = (
        merge_intervals(inside, keys, width)
        .groupBy(*keys)
        .agg(F.sum(F.col("end") - F.col("start")).alias("busy"))
    )
    return windows.join(busy, list(keys), "left").select(
        *keys,
        F.coalesce("busy", F.lit(0)).alias("busy"),
        (F.coalesce("busy", F.lit(0)) / (F.col("win_end") - F.col("win_start")) * 100.0).alias(
            "coverage_percent"
        ),
    )


def copy_statistics(
    copies: DataFrame, windows: DataFrame, keys: Sequence[str], kind: str, nbytes: str, frames: Column
) -> DataFrame:
    """Copies by direction: those inside the window, and those ended before it."""
    joined = copies.join(windows, list(keys))
    start, end = F.col("start"), F.col("end")
    lo, hi = F.col("win_start"), F.col("win_end")
    cut = F.least(end, hi) - F.greatest(start, lo)
    inside = (end > lo) & (start < hi) & (cut > 0)
    before = end <= lo
    mib = 1024.0 * 1024.0
    return (
        joined.withColumns({"_in": inside, "_before": before, "_cut": cut, "_frames": frames})
        .groupBy(*keys, kind)
        .agg(
            F.count_if("_in").alias("copies"),
            F.coalesce(F.sum(F.when(F.col("_in"), F.col(nbytes))), F.lit(0)).alias("bytes"),
            (F.coalesce(F.sum(F.when(F.col("_in"), F.col(nbytes))), F.lit(0)) / F.max("_frames") / mib)
            .alias("mib_per_frame"),
            (F.coalesce(F.sum(F.when(F.col("_in"), F.col("_cut"))), F.lit(0)) / F.max("_frames") / 1e6)
            .alias("ms_per_frame"),
            F.count_if("_before").alias("startup_copies"),
            F.coalesce(F.sum(F.when(F.col("_before"), F.col(nbytes))), F.lit(0)).alias("startup_bytes"),
        )
    )


def trace_name_summary(df: DataFrame, keys: Sequence[str], name: str, duration: Column) -> DataFrame:
    """Count, total, mean, minimum and maximum duration per name."""
    return df.withColumn("_d", duration).groupBy(*keys, name).agg(
        F.count("*").alias("calls"), F.sum("_d").alias("total"), F.avg("_d").alias("mean"),
        F.min("_d").alias("shortest"), F.max("_d").alias("longest"),
    )


def resolve_names(df: DataFrame, strings: DataFrame, id_column: str, inline: str, out: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Dictionary-encoded text: the dictionary entry, else the text stored in the row.

    ``keys`` name the trace: every trace has a dictionary of its own.
    """
    dictionary = strings.select(*keys, F.col("id").alias(id_column), F.col("value").alias("_value")).filter(F.col(id_column).isNotNull())
    return join_on(df, dictionary, [*keys, id_column], "left").withColumn(
        out, F.coalesce("_value", F.col(inline))
    ).drop("_value")


def single_window(named: DataFrame, keys: Sequence[str], label: Column) -> DataFrame:
    """The one complete interval with this label per key; ``window_error`` says what is wrong."""
    hits = named.filter(label).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("start").alias("win_start"), F.max("end").alias("win_end")
    )
    bad = (F.col("_n") != 1) | F.col("win_end").isNull() | (F.col("win_end") <= F.col("win_start"))
    return hits.withColumn("window_error", F.when(bad, F.lit("lacks one complete window"))).drop("_n")


def enum_filter(fact: DataFrame, enum: DataFrame, enum_id: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Facts whose enum id carries this name in their trace (``keys``); the name must be unique there."""
    wanted = (
        enum.filter(F.col("name") == name)
        .groupBy(*keys, "name")
        .agg(F.count("*").alias("_n"), F.first("id").alias(enum_id))
        .filter((F.col("_n") == 1) & F.col(enum_id).isNotNull())
        .select(*keys, enum_id)
    )
    return join_on(fact, wanted, [*keys, enum_id], "left_semi")


def trace_findings(
    windows: DataFrame,
    kernels: DataFrame,
    video: DataFrame,
    copies: DataFrame,
    keys: Sequence[str],
    width: int,
    frames: Column,
) -> DataFrame:
    """All findings of a trace: coverage, engine overlaps and copy totals per key.

    ``video`` has a column ``engine`` (decode, encode), ``copies`` has ``direction``
    (h2d, d2h, d2d) and ``bytes``.
    """
    lo, hi = F.col("win_start"), F.col("win_end")
    span = windows.select(*keys, "win_start", "win_end")
    cut = lambda df: clip(df.join(span, list(keys)), lo, hi).drop("win_start", "win_end")
    # One sweep over kernels and both engines yields every busy time and overlap.
    tagged = cut(video).select(*keys, "engine", "start", "end").unionByName(
        cut(kernels).select(*keys, F.lit("kernel").alias("engine"), "start", "end"))
    kind = F.col("engine")
    states = sweep_states(
        tagged, keys, {f"_{n}": kind == n for n in ("kernel", "decode", "encode")}, width)
    on = lambda n: F.col(f"_{n}") > 0
    share = lambda n: (
        busy_time(on(n) & on("kernel")) / F.nullif(busy_time(on(n)), F.lit(0).cast("long")) * 100.0
    ).alias(f"{n}_overlap_percent")
    engines = states.groupBy(*keys).agg(busy_time(on("kernel")).alias("_kernel"), share("decode"), share("encode"))
    moved = copy_statistics(
        copies.withColumnRenamed("direction", "_dir"), span.withColumn("_f", frames), keys, "_dir", "bytes", F.col("_f")
    )
    pick = lambda d, c: F.coalesce(F.max(F.when(F.col("_dir") == d, F.col(c))), F.lit(0))
    mib = 1024.0 * 1024.0
    totals = moved.groupBy(*keys).agg(
        pick("h2d", "startup_copies").alias("startup_h2d_copies"),
        (pick("h2d", "startup_bytes") / mib).alias("startup_h2d_mib"),
        pick("h2d", "copies").alias("loop_h2d_copies"),
        (pick("h2d", "bytes") / mib).alias("loop_h2d_mib"),
        pick("d2h", "copies").alias("loop_d2h_copies"),
        (pick("d2h", "bytes") / mib).alias("loop_d2h_mib"),
        pick("d2d", "copies").alias("loop_d2d_copies"),
        pick("d2d", "mib_per_frame").cast("double").alias("d2d_mib_per_frame"),
        pick("d2d", "ms_per_frame").cast("double").alias("d2d_ms_per_frame"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = span.join(engines, list(keys), "left").join(totals, list(keys), "left")
    return joined.select(
        *keys,
        ((hi - lo) / 1e9).alias("frame_loop_sec"),
        (zero("_kernel") / (hi - lo) * 100.0).alias("kernel_coverage_percent"),
        "decode_overlap_percent",
        "encode_overlap_percent",
        *[zero(F.col(c)).alias(c) for c in (
            "startup_h2d_copies", "startup_h2d_mib", "loop_h2d_copies", "loop_h2d_mib",
            "loop_d2h_copies", "loop_d2h_mib", "loop_d2d_copies", "d2d_mib_per_frame", "d2d_ms_per_frame",
        )],
        (zero(F.col("loop_h2d_mib")) + zero(F.col("loop_d2h_mib")) > 0).alias("loop_host_copies"),
    )
