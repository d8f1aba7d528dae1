"""Run statistics: suites, stability, campaigns and comparisons with a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators.quantiles import exact_quantiles
from fleetgauge.operators.segments import join_on


def relative_spread(low: str, high: str, median: str) -> Column:
    return F.when(F.col(median) > 0, (F.col(high) - F.col(low)) / F.col(median))


def suite_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs, median, minimum, maximum and relative spread (null unless the median is positive)."""
    return implementation_statistics(df, keys, value, {})


def suite_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every single run value next to the statistics of its suite (rows, not one array)."""
    return join_on(df, suite_statistics(df, keys, value), keys)


def needs_extension(stats: DataFrame, threshold: float) -> DataFrame:
    return stats.withColumn("extend", F.coalesce(F.col("relative_spread") > threshold, F.lit(False)))


def suite_status(
    runs: DataFrame, keys: Sequence[str], value: str, valid: Column, invariant: str,
    initial_runs: int, extra_runs: int, spread_threshold: float, max_spread: float | None = None,
) -> DataFrame:
    """``valid``, ``unstable`` or ``invalid`` per suite.

    A suite needs ``initial_runs`` runs, plus ``extra_runs`` when its first runs spread more
    than the threshold; all must be valid and share one ``invariant`` value (nulls ignored).
    ``run_index`` gives the order of runs.
    """
    first = runs.filter(F.col("run_index") <= initial_runs)
    early = suite_statistics(first.filter(valid), keys, value).select(
        *keys, F.col("relative_spread").alias("_early")
    )
    whole = suite_statistics(runs.filter(valid), keys, value)
    counts = runs.withColumn("_ok", valid).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all"),
        F.coalesce(F.min(F.when(F.col("_ok"), F.col(invariant))) == F.max(F.when(F.col("_ok"), F.col(invariant))), F.lit(True)).alias("_same"),
    )
    limit = max_spread if max_spread is not None else spread_threshold
    target = F.when(F.col("_early") > spread_threshold, initial_runs + extra_runs).otherwise(initial_runs)
    sound = F.col("_all") & F.col("_same") & (F.col("_n") == target)
    stable = sound & F.coalesce(F.col("relative_spread") <= limit, F.lit(False))
    joined = join_on(join_on(counts, early, keys, "left"), whole.drop("runs"), keys, "left")
    return joined.select(
        *keys, F.col("_n").alias("runs"), target.cast("int").alias("target_runs"), "median_fps", "relative_spread",
        F.when(stable, "valid").when(sound, "unstable").otherwise("invalid").alias("status"),
    )


def stability(df: DataFrame, keys: Sequence[str], round_column: str, value: str, threshold: float) -> DataFrame:
    """Verdict over three or five rounds, then over the narrowest four of five.

    Rounds are numbered 1..5, so five conditional maxima hold a group: no list is gathered and
    the aggregation combines map-side.  A group that is not three or five complete rounds comes
    back as ``incomplete`` without spreads.
    """
    slots = [F.max(F.when(F.col(round_column) == i, F.col(value))).alias(f"_r{i}") for i in range(1, 6)]
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count_distinct(round_column).alias("rounds"), F.max(round_column).alias("_last"), *slots
    )
    values = F.array_compact(F.array(*[F.col(f"_r{i}") for i in range(1, 6)]))
    ordered = F.array_sort(values)
    usable = F.col("rounds").isin(3, 5) & (F.col("_rows") == F.col("rounds")) & (F.col("_last") == F.col("rounds"))
    at = lambda a, i: F.element_at(a, i)
    spread5 = (F.array_max(values) - F.array_min(values)) / F.try_element_at(ordered, ((F.col("rounds") + 1) / 2).cast("int"))

    def without(position: int) -> Column:
        kept = F.array_sort(F.array(*[F.col(f"_r{i}") for i in range(1, 6) if i != position]))
        middle = (at(kept, 2) + at(kept, 3)) / 2
        # Ties go to the subset with the earliest rounds, i.e. to the latest excluded round.
        return F.struct(((at(kept, 4) - at(kept, 1)) / middle).alias("spread"), F.lit(-position).alias("excluded"))

    best = F.least(*[without(i) for i in range(1, 6)])
    judged = wide.withColumns({"full_spread": F.when(usable, spread5)}).withColumn(
        "_best", F.when((F.col("rounds") == 5) & (F.col("full_spread") > threshold), best)
    )
    consensus = F.col("_best.spread")
    outlier = F.when(consensus <= threshold, -F.col("_best.excluded"))
    return judged.select(
        *keys, "rounds", "full_spread", consensus.alias("consensus_spread"), outlier.alias("outlier_round"),
        F.when(~F.coalesce(usable, F.lit(False)), "incomplete").when(F.col("full_spread") <= threshold, "stable").when(F.col("rounds") == 3, "needs-extra-runs")
        .when(consensus <= threshold, "stable-with-one-outlier").otherwise("unstable").alias("stability"),
    )


def implementation_statistics(df: DataFrame, keys: Sequence[str], fps: str, medians: dict[str, str]) -> DataFrame:
    """Suite statistics plus the median of each named metric (``alias -> column``) in one pass."""
    wanted = {"median_fps": (fps, 0.5), "min_fps": (fps, 0.0), "max_fps": (fps, 1.0),
              **{alias: (column, 0.5) for alias, column in medians.items()}}
    return exact_quantiles(df, keys, wanted, {"runs": fps}).withColumn(
        "relative_spread", relative_spread("min_fps", "max_fps", "median_fps")
    )


def median_phase_intervals(
    df: DataFrame, keys: Sequence[str], run: str, name: str, value: str, out: str
) -> DataFrame:
    """Median of each named interval over the runs of a group.

    ``same_names`` is false where runs disagree on the names: every name must then occur in
    every run, which the two counts tell without gathering name lists.
    """
    runs = df.select(*keys, run).distinct().groupBy(*keys).agg(F.count("*").alias("_runs"))
    per_name = df.select(*keys, name, run).distinct().groupBy(*keys, name).agg(F.count("*").alias("_in"))
    same = join_on(per_name, runs, keys).groupBy(*keys).agg(
        F.bool_and(F.col("_in") == F.col("_runs")).alias("same_names")
    )
    return join_on(exact_quantiles(df, [*keys, name], {out: (value, 0.5)}), same, keys)


def relative_to_baseline(df: DataFrame, group: Sequence[str], implementation: str, baseline: str, value: str) -> DataFrame:
    """Percent difference to the baseline row of the group (null without one)."""
    base = df.groupBy(*group).agg(F.max(F.when(F.col(implementation) == baseline, F.col(value))).alias("_base"))
    return join_on(df, base, group).withColumn(
        "relative_percent", (F.col(value) / F.col("_base") - 1) * 100
    ).drop("_base")


def campaign_summary(df: DataFrame, campaign: Sequence[str], gaps: Column | None = None) -> DataFrame:
    """Status, warnings and publishability per campaign over implementation rows.

    ``df`` has implementation, rounds, stability; ``gaps`` counts open publication gaps.
    """
    bad = F.col("stability").isin("needs-extra-runs", "unstable", "incomplete")
    outlier = F.col("stability") == "stable-with-one-outlier"
    gap = gaps if gaps is not None else F.lit(0)
    grouped = df.withColumn("_gap", gap).groupBy(*campaign).agg(
        F.max("rounds").alias("rounds"), F.count_if(bad).alias("unstable_implementations"),
        F.count_if(outlier).alias("warnings"), F.max("_gap").alias("gaps"),
    )
    some = F.col("unstable_implementations") > 0
    status = F.when(some & (F.col("rounds") == 3), "needs-extra-runs").when(some, "unstable").otherwise("valid")
    return grouped.withColumn("status", status).withColumn(
        "publishable", (F.col("status") == "valid") & (F.col("gaps") == 0)
    )


def fastest_other(df: DataFrame, group: Sequence[str], implementation: str, baseline: str,
                  fps: str, costs: Sequence[str]) -> DataFrame:
    """Fastest row that is not the baseline, its lead and the cost ratios per group."""
    fields = F.struct(implementation, fps, *costs)
    is_base = F.col(implementation) == baseline
    other = F.max_by(fields, F.when(~is_base, F.struct(F.col(fps), F.col(implementation))))
    both = df.groupBy(*group).agg(
        other.alias("_o"), F.max_by(fields, F.when(is_base, F.col(fps))).alias("_b")
    ).filter(F.col("_o").isNotNull() & F.col("_b").isNotNull())
    return both.select(
        *group, F.col(f"_o.{implementation}").alias("fastest"), F.col(f"_o.{fps}").alias("fastest_fps"),
        ((F.col(f"_b.{fps}") / F.col(f"_o.{fps}") - 1) * 100).alias("delta_percent"),
        *[(F.col(f"_o.{x}") / F.col(f"_b.{x}")).alias(f"{x}_ratio") for x in costs],
    )


def confirm_vs_final(first: DataFrame, final: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Percent change between two measurements of the same winners."""
    before = first.select(*keys, F.col(value).alias("confirmation_fps"))
    after = final.select(*keys, F.col(value).alias("final_fps"))
    return before.join(after, list(keys)).withColumn(
        "delta_percent", (F.col("final_fps") / F.col("confirmation_fps") - 1.0) * 100.0
    )


def largest_change(changes: DataFrame, group: Sequence[str]) -> DataFrame:
    return changes.groupBy(*group).agg(F.max(F.abs("delta_percent")).alias("max_absolute_delta_percent"))


def session_scaling(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ratio of one metric between two independent sessions."""
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys)).select(
        *keys, F.when(F.col("_a") != 0, F.col("_b") / F.col("_a")).alias("scaling")
    )


def stage_profile(df: DataFrame, run: Sequence[str], frame: str, stage: str, ms: str, warmup: int) -> DataFrame:
    """Mean ms per stage after the warm-up frames (kept when there are no others), with shares.

    ``frame`` is a dense 0-based index.
    """
    totals = df.groupBy(*run).agg((F.max(frame) + 1).alias("_frames"))
    skip = F.when(F.col("_frames") > warmup, warmup).otherwise(0)
    kept = df.join(totals, list(run)).filter(F.col(frame) >= skip)
    means = kept.groupBy(*run, stage).agg(F.count("*").alias("frames"), F.avg(ms).alias("stage_ms"))
    # One row per stage here, so the window is over a handful of rows.
    total = F.sum("stage_ms").over(Window.partitionBy(*run))
    return means.withColumn("share_percent", F.when(total > 0, F.col("stage_ms") / total * 100).otherwise(0.0))


def frame_time_stats(df: DataFrame, run: Sequence[str], frame: str, seconds: str) -> DataFrame:
    """Frame count, mean, extremes and rate, also without the first frame (index 0)."""
    rest = F.avg(F.when(F.col(frame) > 0, F.col(seconds)))
    rate = lambda name: F.when(F.col(name) > 0, 1.0 / F.col(name)).otherwise(0.0)
    return df.groupBy(*run).agg(
        F.count("*").alias("frames"), F.avg(seconds).alias("average"), F.min(seconds).alias("shortest"),
        F.max(seconds).alias("longest"), F.coalesce(rest, F.avg(seconds)).alias("average_without_first"),
    ).withColumns({"fps": rate("average"), "fps_without_first": rate("average_without_first")})


def parity_class(delta_percent: Column, band: float = 5.0) -> Column:
    """Advantage above the band, loss below it, parity inside."""
    return F.when(delta_percent > band, "advantage").when(delta_percent < -band, "loss").when(
        delta_percent.isNotNull(), "parity")


def cost_ratios(df: DataFrame, group: Sequence[str], ratios: Sequence[str]) -> DataFrame:
    """Smallest and largest ratio per group."""
    return df.groupBy(*group).agg(*[f(x).alias(f"{n}_{x}") for x in ratios for n, f in (("min", F.min), ("max", F.max))])


def matrix_check(df: DataFrame, keys: Sequence[str], required: Sequence[str], contract: Sequence[str]) -> DataFrame:
    """All required variants present once, each valid and publishable, one contract over all.

    Rows outside the required variants count as unexpected.  Counts and min/max stand in for
    gathered sets, so a group of any size is combined map-side.
    """
    known = F.col("variant").isin(*required)
    keyed = df.withColumn("_contract", F.sha2(F.to_json(F.struct(*contract), {"ignoreNullFields": "false"}), 256))
    grouped = keyed.groupBy(*keys).agg(
        F.count_distinct(F.when(known, F.col("variant"))).alias("_have"), F.count_if(F.coalesce(known, F.lit(False))).alias("_rows"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("_extra"),
        F.bool_and((F.col("status") == "valid") & F.col("publishable")).alias("_ok"),
        (F.min("_contract") == F.max("_contract")).alias("_same"),
    )
    return grouped.select(*keys, R.labels([
        ("required variants are missing", F.col("_have") != len(required)),
        ("required variants occur more than once", F.col("_rows") > F.col("_have")),
        ("unexpected variants", F.col("_extra") > 0),
        ("a campaign is not publishable", ~R.when_present(F.col("_ok"))),
        ("shared contract changed", ~F.col("_same")),
    ]).alias("errors"))


def shared_contract(df: DataFrame, session: Sequence[str], implementation: str,
                    session_key: str, implementation_key: str) -> DataFrame:
    """One session key for all rows of a session, one implementation key per implementation."""
    inner = df.groupBy(*session, implementation).agg(
        F.min(session_key).alias("_lo"), F.max(session_key).alias("_hi"),
        (F.min(implementation_key) != F.max(implementation_key)).alias("_changed"),
    )
    return inner.groupBy(*session).agg(
        F.coalesce(F.min("_lo") != F.max("_hi"), F.lit(False)).alias("session_changed"),
        F.count_if("_changed").alias("changed_implementations"),
    )
