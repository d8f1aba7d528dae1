"""Device samples, CPU counters and lifecycle markers of measured runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators.segments import SEGMENT, by_width, spread

# Clock limit reasons, their bits, and those that spoil a measurement.
THROTTLE_BITS = {
    "gpu_idle": 0x1,
    "applications_clocks_setting": 0x2,
    "sw_power_cap": 0x4,
    "hw_slowdown": 0x8,
    "sync_boost": 0x10,
    "sw_thermal_slowdown": 0x20,
    "hw_thermal_slowdown": 0x40,
    "hw_power_brake_slowdown": 0x80,
    "display_clock_setting": 0x100,
}
INVALID_REASONS = ("hw_slowdown", "sw_thermal_slowdown", "hw_thermal_slowdown", "hw_power_brake_slowdown")
# Seconds of samples that one task orders.
SEGMENT_SECONDS = 3_600.0


def decode_bitmask(mask: Column, names: dict[str, int] = THROTTLE_BITS) -> Column:
    """Sorted names of the bits set in ``mask``; null gives an empty array."""
    hits = [F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in sorted(names.items())]
    return F.array_compact(F.array(*hits))


def boundary_asof(samples: DataFrame, windows: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str) -> DataFrame:
    """Per window the sample that stands for each border.

    Start: the last sample at or before ``lo``, else the first one.  End: the first sample at
    or after ``hi``, else the last one.  One aggregation with map-side combine, no range join.
    """
    row = F.struct(*[F.col(f) for f in samples.columns])
    at = F.col(t)
    joined = samples.join(windows.select(*keys, lo, hi), list(keys))
    return joined.groupBy(*keys, lo, hi).agg(
        F.coalesce(F.max_by(row, F.when(at <= F.col(lo), at)), F.min_by(row, at)).alias("at_start"),
        F.coalesce(F.min_by(row, F.when(at >= F.col(hi), at)), F.max_by(row, at)).alias("at_end"),
    )


def clip_to_window(samples: DataFrame, runs: DataFrame, keys: Sequence[str], t: str = "relative_sec",
                   wall: str = "wall_time_sec") -> DataFrame:
    """Samples inside (0, wall) plus copies of the border samples at 0 and wall."""
    windows = runs.select(*keys, F.lit(0.0).alias("_lo"), F.col(wall).alias("_hi"))
    edges = boundary_asof(samples, windows, keys, t, "_lo", "_hi")
    border = edges.select(
        F.inline(F.array(
            F.col("at_start").withField(t, F.col("_lo")),
            F.col("at_end").withField(t, F.col("_hi")),
        ))
    )
    inside = samples.join(windows, list(keys)).filter((F.col(t) > F.col("_lo")) & (F.col(t) < F.col("_hi")))
    return inside.select(*samples.columns).unionByName(border)


def energy_trapezoid(samples: DataFrame, keys: Sequence[str], t: str = "relative_sec", power: str = "power_w",
                     segment_seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Energy per run; samples without power and steps that do not advance are skipped.

    Trapezoids are summed inside time segments; the trapezoid across a border needs only the
    last sample before it and the first one after it.
    """
    pair = F.when(F.col(power).isNotNull(), F.struct(F.col(t).alias("t"), F.col(power).alias("p")))
    data = samples.select(*keys, by_width(F.col(t), segment_seconds).alias(SEGMENT), F.col(t).alias("_t"), pair.alias("_now"))
    earlier = (Window.unboundedPreceding, -1)
    local = Window.partitionBy(*keys, SEGMENT).orderBy("_t").rowsBetween(*earlier)
    across = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(*earlier)
    term = _trapezoid(F.last("_now", ignorenulls=True).over(local), F.col("_now"))
    parts = spread(data, keys).withColumn("_term", term).groupBy(*keys, SEGMENT).agg(
        F.sum("_term").alias("_energy"), F.min("_now").alias("_head"), F.max("_now").alias("_tail"))
    joint = _trapezoid(F.last("_tail", ignorenulls=True).over(across), F.col("_head"))
    return parts.withColumn("_energy", _sum_known(F.col("_energy"), joint)).groupBy(*keys).agg(F.sum("_energy").alias("energy_j"))


def _trapezoid(before: Column, now: Column) -> Column:
    elapsed = now["t"] - before["t"]
    return F.when(elapsed > 0, elapsed * (now["p"] + before["p"]) / 2)


def _sum_known(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))


# How a metric of one sample is merged, first over the samples of a segment, then over segments.
_MERGE = {
    "sum": F.sum, "max": F.max, "min": F.min,
    # Distinct reason lists of a nine-name vocabulary: the buffer cannot grow with the run.
    "union": lambda column: F.array_distinct(F.flatten(F.collect_set(column))),
}
PARTS = ("count", "power", "memory", "utilization", "temperature", "clocks", "processes", "throttle", "limit")


def _sample_metrics(part: str, value, at: Column) -> dict[str, tuple[str, Column]]:
    """``name -> (merge, value of one sample)``; ``value(name)`` reads a sample field.

    A first value is the smallest (time, value) pair, so it merges like any minimum.
    """
    known = lambda name: F.when(value(name).isNotNull(), 1).cast("long")
    stamped = lambda name: F.struct(at.alias("t"), value(name).alias("v"))
    first = lambda name: ("min", F.when(value(name).isNotNull(), stamped(name)))
    if part == "count":
        return {"sample_count": ("sum", F.lit(1).cast("long"))}
    if part == "power":
        pair = F.when(value("power_w").isNotNull(), F.struct(at.alias("t"), value("power_w").alias("p")))
        return {"peak_w": ("max", value("power_w")), "power_samples": ("sum", known("power_w")), "_head": ("min", pair), "_tail": ("max", pair)}
    if part == "memory":
        return {"_memory": first("memory_used_mib"), "peak_used_mib": ("max", value("memory_used_mib"))}
    if part == "utilization":
        gpu = "gpu_utilization_percent"
        return {"_gpu_sum": ("sum", value(gpu).cast("long")), "_gpu_n": ("sum", known(gpu)), "peak_gpu_percent": ("max", value(gpu))}
    if part == "temperature":
        return {"_start_c": first("temperature_c"), "peak_c": ("max", value("temperature_c"))}
    if part == "clocks":
        return {
            f"{short}_{kind}_mhz": (kind, value(f"{short}_clock_mhz")) for short in ("graphics", "memory") for kind in ("min", "max")}
    if part == "processes":
        return {
            "_baseline_compute": ("min", stamped("compute_process_count")), "_baseline_graphics": ("min", stamped("graphics_process_count")),
            "max_compute_count": ("max", value("compute_process_count")), "max_graphics_count": ("max", value("graphics_process_count"))}
    if part == "throttle":
        return {"throttle_reasons": ("union", value("throttle_reasons"))}
    if part == "limit":
        return {"limit_min_w": ("min", value("power_limit_w")), "limit_max_w": ("max", value("power_limit_w"))}
    raise ValueError(part)


def _finish(part: str) -> dict[str, Column]:
    c = F.col
    return {
        "memory": {"baseline_used_mib": c("_memory.v")},
        "utilization": {"average_gpu_percent": c("_gpu_sum") / c("_gpu_n")},
        "temperature": {"start_c": c("_start_c.v")},
        "processes": {"baseline_compute": c("_baseline_compute.v"), "baseline_graphics": c("_baseline_graphics.v")},
        "throttle": {"throttle_reasons": F.array_sort("throttle_reasons")},
    }.get(part, {})


def window_metrics(samples: DataFrame, runs: DataFrame, keys: Sequence[str], parts: Iterable[str] = PARTS,
                   t: str = "relative_sec", wall: str = "wall_time_sec", segment_seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Metrics of the samples clipped to (0, wall), one row per run, in one pass over the samples.

    Samples are shuffled once, by (run, time segment), and reduced to one row per segment with
    the candidates for the two border samples.  The rest works on those few rows: the border
    samples join the first and the last segment, energy is added across segment borders, and
    the segments are merged.
    """
    parts = list(parts)
    c, at = F.col, F.col(t)
    edge = F.struct(F.col(t).alias("_t"), F.struct(*samples.columns).alias("_row"))
    inside = (at > 0) & (at < c("_wall"))

    def metrics(value, moment: Column) -> dict[str, tuple[str, Column]]:
        found: dict[str, tuple[str, Column]] = {}
        for part in parts:
            found |= _sample_metrics(part, value, moment)
        return found

    per_sample = metrics(F.col, at)
    data = samples.join(runs.select(*keys, F.col(wall).alias("_wall")), list(keys)).withColumn(SEGMENT, by_width(at, segment_seconds))
    energy = "power" in parts
    if energy:
        pair = F.when(inside & c("power_w").isNotNull(), F.struct(at.alias("t"), c("power_w").alias("p")))
        earlier = Window.partitionBy(*keys, SEGMENT).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
        data = spread(data, keys).withColumn("_term", _trapezoid(F.last(pair, ignorenulls=True).over(earlier), pair))
    segments = data.groupBy(*keys, SEGMENT).agg(
        F.max("_wall").alias("_wall"),
        F.max(F.when(at <= 0, edge)).alias("_pre"), F.min(F.when(at >= c("_wall"), edge)).alias("_post"),
        F.min(edge).alias("_first"), F.max(edge).alias("_last"),
        *([F.sum("_term").alias("_energy")] if energy else []),
        *[_MERGE[kind](F.when(inside, column)).alias(name) for name, (kind, column) in per_sample.items()],
    )
    run, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(SEGMENT)
    bordered = segments.withColumns({
        "_start": F.coalesce(F.max("_pre").over(run), F.min("_first").over(run))["_row"],
        "_end": F.coalesce(F.min("_post").over(run), F.max("_last").over(run))["_row"],
        "_opens": F.lag(SEGMENT).over(ordered).isNull(), "_closes": F.lead(SEGMENT).over(ordered).isNull(),
    })

    def piece(place: int, columns: dict[str, Column]) -> Column:
        extra = {"_energy": columns.pop("_energy", F.lit(None).cast("double"))} if energy else {}
        return F.struct(F.lit(place).alias("_place"), *[v.alias(n) for n, v in {**extra, **columns}.items()])

    def border(name: str, moment: Column, place: int) -> Column:
        return piece(place, {n: column for n, (_, column) in metrics(lambda field: c(name)[field], moment).items()})

    whole = piece(1, {n: c(n) for n in ([*per_sample, "_energy"] if energy else per_sample)})
    pieces = bordered.select(*keys, SEGMENT, F.inline(F.array_compact(F.array(
        F.when(c("_opens"), border("_start", F.lit(0.0), 0)), whole, F.when(c("_closes"), border("_end", c("_wall"), 2))))))
    if energy:
        before = Window.partitionBy(*keys).orderBy(SEGMENT, "_place").rowsBetween(Window.unboundedPreceding, -1)
        joint = _trapezoid(F.last("_tail", ignorenulls=True).over(before), c("_head"))
        pieces = pieces.withColumn("_energy", _sum_known(c("_energy"), joint))
    merged = pieces.groupBy(*keys).agg(
        *([F.sum("_energy").alias("energy_j")] if energy else []),
        *[_MERGE[kind](name).alias(name) for name, (kind, _) in per_sample.items()])
    finished: dict[str, Column] = {}
    for part in parts:
        finished |= _finish(part)
    return merged.withColumns(finished).drop(*[n for n in per_sample if n.startswith("_")]) if finished else merged.drop(
        *[n for n in per_sample if n.startswith("_")])


def power_columns(wall: str = "wall_time_sec", frames: str = "frames") -> dict[str, Column]:
    return {
        "average_w": F.when(F.col(wall) > 0, F.col("energy_j") / F.col(wall)),
        "joules_per_frame": F.when(F.col(frames) > 0, F.col("energy_j") / F.col(frames)),
        "power_cap_observed": F.array_contains("throttle_reasons", "sw_power_cap"),
    }


def peak_delta() -> Column:
    return F.when(
        F.col("peak_used_mib").isNotNull(), F.greatest(F.lit(0.0), F.col("peak_used_mib") - F.col("baseline_used_mib"))
    )


def observed_interval_ms(wall: str = "wall_time_sec") -> Column:
    return F.when(F.col("sample_count") > 1, 1000 * F.col(wall) / (F.col("sample_count") - 1))


def process_rules(max_compute: Column, max_graphics: Column) -> list[R.Rule]:
    c = F.col
    over = lambda label, seen, limit: (
        F.concat(F.lit(f"{label} process count exceeded its limit: at most "), limit.cast("string"), F.lit(", got "), seen.cast("string")),
        seen > limit,
    )
    return [
        ("another compute process was active before the run", c("baseline_compute") != 0),
        ("a graphics process was active", c("baseline_graphics") != 0),
        ("compute process accounting is unavailable", c("max_compute_count").isNull()),
        ("graphics process accounting is unavailable", c("max_graphics_count").isNull()),
        over("compute", c("max_compute_count"), max_compute),
        over("graphics", c("max_graphics_count"), max_graphics),
    ]


def telemetry_summary(samples: DataFrame, runs: DataFrame, keys: Sequence[str], t: str = "relative_sec",
                      segment_seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """All sample metrics of every run, with the ordered error list and the valid flag.

    ``runs``: keys, wall_time_sec, frames, max_compute_processes, max_graphics_processes.  A
    run without samples is kept and marked.
    """
    c = F.col
    found = window_metrics(samples, runs, keys, PARTS, t, segment_seconds=segment_seconds)
    full = runs.join(found, list(keys), "left").withColumn("_none", c("sample_count").isNull())
    seen = ~c("_none")
    invalid = F.array_sort(F.array_intersect("throttle_reasons", F.array(*[F.lit(r) for r in INVALID_REASONS])))
    only = lambda rules: [(label, seen & bad) for label, bad in rules]
    rules: list[R.Rule] = [
        ("wall_time_sec must be greater than zero", ~R.positive(c("wall_time_sec"))),
        ("frames must be greater than zero", ~R.positive(c("frames"))),
        ("process limits cannot be negative", (c("max_compute_processes") < 0) | (c("max_graphics_processes") < 0)),
        ("sampler produced no samples", c("_none")),
        *only([
            ("power sampling requires at least two samples", c("power_samples") < 2),
            ("memory usage is unavailable", c("peak_used_mib").isNull()),
            (F.concat(F.lit("invalid throttle reasons observed: "), F.array_join(invalid, ", ")), F.size(invalid) > 0),
            *process_rules(c("max_compute_processes"), c("max_graphics_processes")),
            ("power limit is unavailable", c("limit_min_w").isNull()),
            ("power limit changed during the run", c("limit_min_w") != c("limit_max_w")),
            ("temperature sampling is unavailable", c("peak_c").isNull()),
            ("utilization sampling is unavailable", c("peak_gpu_percent").isNull()),
            ("clock sampling is unavailable", c("graphics_max_mhz").isNull() | c("memory_max_mhz").isNull()),
        ]),
    ]
    return (
        full.withColumns({
            **power_columns(),
            "peak_delta_mib": peak_delta(),
            "sample_interval_observed_ms": observed_interval_ms(),
            "limit_w": F.when(c("limit_min_w") == c("limit_max_w"), c("limit_min_w")),
            "sample_count": F.coalesce("sample_count", F.lit(0)),
            "errors": R.labels(rules),
        })
        .withColumn("valid", F.size("errors") == 0)
        .drop("_none", "limit_min_w", "limit_max_w", "power_samples", "baseline_compute", "baseline_graphics")
    )


def constant_per_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Whether ``column`` holds at most one value per group, nulls ignored."""
    return df.groupBy(*keys).agg(
        (F.coalesce(F.min(column) == F.max(column), F.lit(True))).alias("constant")
    )


def distinct_process_count(df: DataFrame, keys: Sequence[str], pid: str) -> DataFrame:
    """Processes per group, counted once each."""
    return df.select(*keys, pid).distinct().groupBy(*keys).agg(F.count(pid).alias("processes"))


def counter_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Difference of two cumulative snapshots per run; a counter that went back is an error."""
    start = before.select(*keys, *[F.col(n).alias(f"_b_{n}") for n in counters])
    joined = after.join(start, list(keys))
    out = joined.withColumns({n: F.col(n) - F.col(f"_b_{n}") for n in counters})
    back = F.lit(False)
    for name in counters:
        back = back | (F.col(name) < 0)
    return out.drop(*[f"_b_{n}" for n in counters]).withColumn(
        "errors", R.labels([("counters moved backwards", back)])
    )


def cpu_usage(deltas: DataFrame, wall: str = "wall_time_sec", cpus: str = "logical_cpus") -> DataFrame:
    """Total seconds, average cores and share of capacity from counter differences."""
    total = F.col("user_time_sec") + F.col("system_time_sec")
    cores = F.when(F.col(wall) > 0, total / F.col(wall))
    return deltas.withColumns({
        "total_time_sec": total, "average_cores": cores,
        "capacity_percent": F.when(F.col(cpus) > 0, cores / F.col(cpus) * 100),
    })


def lifecycle_scopes(df: DataFrame) -> DataFrame:
    """Startup, steady and finalise seconds of a run from its nanosecond markers, with errors."""
    c = F.col
    first, last = c("first_frame_completed_ns"), c("last_frame_completed_ns")
    start, finish = c("process_started_ns"), c("process_finished_ns")
    sec = lambda v: v / 1e9
    return df.withColumns({
        "startup_sec": sec(first - start),
        "steady_state_frame_loop_sec": sec(last - first),
        "finalize_mux_sec": sec(finish - last),
        "total_sec": sec(finish - start),
        "steady_state_frames": F.greatest(F.lit(0), c("processed_frames") - 1),
        "errors": R.labels([
            ("first-frame stamp must be positive", ~R.positive(first)),
            ("last frame precedes first frame", last < first),
            ("processed frame count must be positive", ~R.positive(c("processed_frames"))),
            ("instrumentation must be named", R.blank(c("instrumentation"))),
            ("expected frame count must be positive", ~R.positive(c("expected_frames"))),
            ("frame count mismatch", R.differs(c("processed_frames"), c("expected_frames"))),
            ("process duration must be positive", finish <= start),
            ("first frame precedes process", first < start),
            ("last frame follows process", last > finish),
        ]),
    })
