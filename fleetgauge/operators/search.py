"""Decisions over measured scheduling points.

A search has at most one point per setting; inputs must already hold one row per (group,
setting).  A search of any length is cut into segments of its settings, so none is sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators.segments import best_rows, by_width, running, trailing

# Settings of one search that one task orders.
SEGMENT_SETTINGS = 100_000


def confirmed_decline(points: DataFrame, keys: Sequence[str], margin: float, patience: int, setting: str = "num_streams",
                      fps: str = "median_fps", segment_settings: int = SEGMENT_SETTINGS) -> DataFrame:
    """At every prefix of a search: more than ``patience`` points, the last ones all below the best."""
    ordered = running(points.withColumn("_one", F.lit(1)), keys, [setting], by_width(F.col(setting), segment_settings),
                      position=("count", "_one"), _best=("max", fps)).drop("_one")
    recent = trailing(ordered, keys, "position", fps, patience, segment_settings, "_recent", "max")
    return recent.withColumn("position", F.col("position").cast("int")).withColumn(
        "declined", (F.col("position") > patience) & (F.col("_recent") < F.col("_best") * (1 - margin))).drop("_best", "_recent")


def sentinel_recovers(points: DataFrame, keys: Sequence[str], sentinel: Column, margin: float, fps: str = "median_fps") -> DataFrame:
    """Whether the last-range point exceeds the best of the others by the margin."""
    return points.withColumn("_s", sentinel).groupBy(*keys).agg(
        F.max(F.when(F.col("_s"), F.col(fps))).alias("sentinel_fps"), F.max(F.when(~F.col("_s"), F.col(fps))).alias("best_fps")
    ).withColumn("recovers", F.coalesce(F.col("sentinel_fps") > F.col("best_fps") * (1 + margin), F.lit(False)))


def upper_boundary_open(points: DataFrame, keys: Sequence[str], margin: float,
                        setting: str = "num_streams", fps: str = "median_fps") -> DataFrame:
    """Whether the largest setting still improves on all lower ones, or there are too few points."""
    top = points.groupBy(*keys).agg(
        F.count("*").alias("points"), F.max(setting).alias("_top"), F.max_by(fps, setting).alias("top_fps"))
    lower = points.join(top, list(keys)).filter(F.col(setting) < F.col("_top")).groupBy(*keys).agg(F.max(fps).alias("lower_fps"))
    return top.join(lower, list(keys), "left").select(
        *keys, "points",
        ((F.col("points") < 2) | F.coalesce(F.col("top_fps") > F.col("lower_fps") * (1 + margin), F.lit(True))).alias("open"),
    )


def shortlist(points: DataFrame, keys: Sequence[str], size: int,
              setting: str = "num_streams", fps: str = "median_fps", candidate: str = "candidate_id") -> DataFrame:
    """The strongest points per group: rate down, then fewer streams, then id."""
    return best_rows(points, keys, [F.desc(fps), F.col(setting), F.col(candidate)], size)


def peak_equivalent(points: DataFrame, keys: Sequence[str], margin: float, fps: str = "median_fps",
                    order: Sequence[str] = ("num_streams", "cuda_graph", "candidate_id")) -> DataFrame:
    """Cheapest point within the margin of the peak: fewest streams, no graph, smallest id.

    Two map-side combined aggregations and a join; no window over the group.
    """
    peak = points.groupBy(*keys).agg(F.max(fps).alias("_peak"))
    near = points.join(peak, list(keys)).filter(F.col(fps) >= F.col("_peak") * (1 - margin)).drop("_peak")
    rest = [n for n in points.columns if n not in keys]
    return near.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_w")).select(*keys, "_w.*")


def apply_disqualifications(candidates: DataFrame, rejections: DataFrame, key: str, order: str) -> DataFrame:
    """Attach the last rejection of each candidate; rejected ones are not eligible."""
    last = rejections.groupBy(key).agg(F.max_by("reason", order).alias("reject_reason"))
    return candidates.join(last, key, "left").withColumn("eligible", F.col("eligible") & F.col("reject_reason").isNull())


def disqualification_evidence(rejected: DataFrame, comparisons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A rejection must cite a report with exactly one invalid comparison of the product."""
    invalid = comparisons.groupBy(*keys).agg(F.count_if(F.col("status") == "invalid").alias("_invalid"))
    return rejected.join(invalid, list(keys), "left").withColumn(
        "proven", F.coalesce(F.col("_invalid") == 1, F.lit(False))
    ).drop("_invalid")


def common_failure(comparisons: DataFrame, keys: Sequence[str], products: int) -> DataFrame:
    """All candidates invalid with one identical output hash: a fault of the common path."""
    return comparisons.groupBy(*keys).agg(
        ((F.count("*") == products) & (F.count_distinct("implementation") == products)
         & F.bool_and(~(F.col("status") == "valid"))
         & F.bool_and(~R.blank(F.col("output_sha256")))
         & F.coalesce(F.min("output_sha256") == F.max("output_sha256"), F.lit(False))).alias("common_failure"),
        F.min("output_sha256").alias("output_sha256"),
    )


def rank_candidates(candidates: DataFrame, keys: Sequence[str], margin: float) -> DataFrame:
    """Winner per group among eligible candidates, and what is missing.

    ``candidates``: candidate_id, num_streams, cuda_graph, median_fps, eligible, evidence_complete.
    """
    c = F.col
    usable = candidates.filter(c("eligible") & c("evidence_complete") & c("median_fps").isNotNull())
    winners = peak_equivalent(usable, keys, margin).select(*keys, c("candidate_id").alias("winner"), c("median_fps").alias("winner_fps"))
    state = candidates.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(~c("evidence_complete")).alias("incomplete"))
    return state.join(winners, list(keys), "left").withColumn("errors", R.labels([
        ("complete confirmation evidence is missing", c("incomplete") > 0),
        ("no eligible candidate remains", c("winner").isNull()),
    ]))


def search_completion(
    points: DataFrame, states: DataFrame, keys: Sequence[str], low: int, high: int, margin: float, patience: int,
    setting: str = "num_streams", fps: str = "median_fps",
) -> DataFrame:
    """Check the reason a finished search gives for its end.

    ``states``: keys, completion_reason, early_stop (int or null), limit_streams (int or null).
    The sentinel is the highest setting.  Reasons: range-exhausted, decline-confirmed,
    sentinel-recovery-range-exhausted, resource-ceiling.
    """
    c = F.col
    tagged = points.join(states.select(*keys, "early_stop"), list(keys))
    # The regular part of a search: everything but a sentinel that was measured after an early stop.
    regular = c("early_stop").isNull() | (c(setting) != high)
    rate = lambda where: F.max(F.when(where, c(fps)))
    # First scan: a row per setting, then a row per search.
    settings = tagged.groupBy(*keys, setting, "early_stop").agg(F.count("*").alias("_rows"), F.max(fps).alias(fps))
    shape = settings.groupBy(*keys).agg(
        F.sum("_rows").alias("_n"), F.count("*").alias("_d"), F.min(setting).alias("_lo"), F.max(setting).alias("_hi"),
        F.sum(F.when(c(setting) <= c("early_stop"), c("_rows")).otherwise(0)).alias("_before"),
        F.sum(F.when(c(setting) == high, c("_rows")).otherwise(0)).alias("_sentinel"),
        F.sum(F.when(regular, c("_rows")).otherwise(0)).alias("_regular"), rate(regular).alias("_best"),
        rate(c(setting) == high).alias("_last"), rate(c(setting) != high).alias("_others"), F.max_by(fps, setting).alias("_top_fps"))
    # Second scan: the best rate below the largest setting.  Third scan: the best of the last regular points.
    lower = points.join(shape.select(*keys, "_hi"), list(keys)).filter(c(setting) < c("_hi")).groupBy(*keys).agg(F.max(fps).alias("_lower"))
    recent = best_rows(tagged.filter(regular).select(*keys, setting, fps), keys, [F.desc(setting)], patience).groupBy(*keys).agg(F.max(fps).alias("_recent"))
    joined = states
    for part in (shape, lower, recent):
        joined = joined.join(part, list(keys), "left")
    joined = joined.withColumns({
        "_declined": (c("_regular") > patience) & (c("_recent") < c("_best") * (1 - margin)),
        "_recovers": F.coalesce(c("_last") > c("_others") * (1 + margin), F.lit(False)),
        "_open": (c("_n") < 2) | F.coalesce(c("_top_fps") > c("_lower") * (1 + margin), F.lit(True)),
    })
    reason = c("completion_reason")
    dense = lambda first, final: (c("_n") == final - first + 1) & (c("_lo") == first) & (c("_hi") == final)
    full = dense(F.lit(low), F.lit(high))
    to_stop = (c("_lo") == low) & (c("_before") == c("early_stop") - low + 1)
    stopped = to_stop & (c("_n") == c("_before") + 1) & (c("_sentinel") == 1) & (c("early_stop") < high)
    exhausted = reason.isin("range-exhausted", "sentinel-recovery-range-exhausted")
    declined = reason == "decline-confirmed"
    ceiling = reason == "resource-ceiling"
    yes, no = R.when_present, lambda cond: ~R.when_present(cond)
    below = (c("_n") == c("limit_streams") - low) & (c("_lo") == low) & (c("_hi") == c("limit_streams") - 1)
    early = c("early_stop").isNotNull()
    known = exhausted | declined | ceiling
    return joined.select(*keys, "completion_reason", R.labels([
        ("invalid completion reason", no(known)),
        ("points repeat a setting", c("_n") != c("_d")),
        ("unexpected resource limit", (exhausted | declined) & c("limit_streams").isNotNull()),
        ("did not exhaust the range", exhausted & no(full)),
        ("unexpected early stop", (reason == "range-exhausted") & early),
        ("no recovered early-stop point", (reason == "sentinel-recovery-range-exhausted") & ~early),
        ("ended at an increasing upper boundary", exhausted & yes(c("_open"))),
        ("no early-stop point", declined & ~early),
        ("changed the decline-confirmed range", declined & early & no(stopped)),
        ("stopped without a confirmed decline", declined & early & no(c("_declined"))),
        ("ignored a recovering sentinel", declined & early & yes(c("_recovers"))),
        ("no resource-limit evidence", ceiling & c("limit_streams").isNull()),
        ("resource ceiling is not above valid points", ceiling & no(c("limit_streams") > c("_hi"))),
        ("skipped points before its resource ceiling", ceiling & ~early & no(below)),
        ("invalid sentinel stop", ceiling & early & no(c("limit_streams") == high)),
        ("unproven decline before the sentinel", ceiling & early & no(to_stop & (c("_n") == c("_before")) & c("_declined"))),
    ]).alias("errors"))


def confirmation_errors(recon: DataFrame, confirmed: DataFrame, keys: Sequence[str], size: int, margin: float,
                        probes: DataFrame | None = None) -> DataFrame:
    """Confirmed candidates must be exactly the shortlist plus the graph probe of its winner.

    ``probes``: keys, probe_graph.  The probe id replaces the ``-g0`` ending of the winner.
    """
    c = F.col
    short = shortlist(recon, keys, size).select(*keys, "candidate_id")
    measured = confirmed.join(short, [*keys, "candidate_id"], "left_semi")
    winner = peak_equivalent(measured, keys, margin).select(*keys, c("candidate_id").alias("provisional"))
    expected = short
    if probes is not None:
        probe = winner.join(probes.filter(c("probe_graph")), list(keys)).select(
            *keys, F.regexp_replace("provisional", "-g0$", "-g1").alias("candidate_id"))
        expected = short.unionByName(probe)
    want = expected.distinct().withColumn("_e", F.lit(True))
    have = confirmed.select(*keys, "candidate_id").distinct().withColumn("_a", F.lit(True))
    counts = want.join(have, [*keys, "candidate_id"], "full").groupBy(*keys).agg(
        F.count_if(c("_a").isNull()).alias("missing"), F.count_if(c("_e").isNull()).alias("unexpected"))
    return counts.join(winner, list(keys), "left").withColumn("errors", R.labels([
        ("incomplete confirmation evidence", c("missing") > 0),
        ("unexpected confirmation candidates", c("unexpected") > 0),
        ("no provisional winner", c("provisional").isNull()),
    ]))
