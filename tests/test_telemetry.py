import math
import random

from pyspark.sql import functions as F

from fleetgauge.operators import telemetry as tm

SCHEMA = (
    "run_id string, relative_sec double, power_w double, memory_used_mib double, gpu_utilization_percent int, temperature_c int, "
    "graphics_clock_mhz int, memory_clock_mhz int, power_limit_w double, compute_process_count int, graphics_process_count int, throttle_reasons array<string>"
)
RUNS = "run_id string, wall_time_sec double, frames int, max_compute_processes int, max_graphics_processes int"


def sample(run, t, power=100.0, memory=100.0, compute=0, graphics=0, reasons=(), util=50, limit=350.0):
    return (run, t, power, memory, util, 60, 2000, 9000, limit, compute, graphics, list(reasons))


def summary(spark, samples, runs, **options):
    out = tm.telemetry_summary(spark.createDataFrame(samples, SCHEMA), spark.createDataFrame(runs, RUNS), ["run_id"], **options)
    return {r.run_id: r for r in out.collect()}


def test_energy_memory_and_rate(spark):
    rows = [sample("a", 0.0, 100.0, 100.0), sample("a", 0.5, 200.0, 500.0, 1), sample("a", 1.0, 100.0, 400.0, 1)]
    a = summary(spark, rows, [("a", 1.0, 100, 1, 0)])["a"]
    assert (a.energy_j, a.average_w, a.joules_per_frame, a.peak_delta_mib, a.valid) == (150.0, 150.0, 1.5, 400.0, True)
    assert a.sample_count == 3 and a.sample_interval_observed_ms == 500.0


def test_process_limits(spark):
    rows = [sample("a", 0.0, compute=1), sample("a", 1.0, compute=2)]
    a = summary(spark, rows, [("a", 1.0, 10, 1, 0)])["a"]
    assert a.errors == ["another compute process was active before the run",
                        "compute process count exceeded its limit: at most 1, got 2"]


def test_run_without_samples_is_marked(spark):
    found = summary(spark, [sample("a", 0.0)], [("a", 1.0, 1, 1, 0), ("b", 1.0, 1, 1, 0)])
    assert found["b"].errors == ["sampler produced no samples"] and found["b"].sample_count == 0
    # A single sample stands at both borders.
    assert found["a"].sample_count == 2 and found["a"].energy_j == 100.0


def test_invalid_reasons_and_changed_limit(spark):
    rows = [sample("a", 0.0, reasons=["gpu_idle"]), sample("a", 0.4, reasons=["hw_slowdown", "sw_power_cap"], limit=300.0), sample("a", 1.0)]
    a = summary(spark, rows, [("a", 1.0, 1, 1, 0)])["a"]
    assert a.throttle_reasons == ["gpu_idle", "hw_slowdown", "sw_power_cap"] and a.power_cap_observed and a.limit_w is None
    assert a.errors == ["invalid throttle reasons observed: hw_slowdown", "power limit changed during the run"]


def brute(rows, wall):
    """The rules of clipping and integration, spelled out over a sorted list."""
    rows = sorted(rows, key=lambda r: r[1])
    before, after = [r for r in rows if r[1] <= 0], [r for r in rows if r[1] >= wall]
    start, end = (before[-1] if before else rows[0]), (after[0] if after else rows[-1])
    kept = [(0.0, start)] + [(r[1], r) for r in rows if 0 < r[1] < wall] + [(wall, end)]
    power = [(t, r[2]) for t, r in kept if r[2] is not None]
    energy = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(power, power[1:]) if b[0] > a[0])
    memory = [r[3] for _, r in kept if r[3] is not None]
    return energy, len(kept), (max(0.0, max(memory) - memory[0]) if memory else None), max((p for _, p in power), default=None)


def test_segments_do_not_change_results(spark):
    rng = random.Random(7)
    rows, runs = [], []
    for run, (count, wall) in {"hot": (900, 50.0), "b": (40, 9.0), "c": (3, 100.0), "d": (5, 0.5)}.items():
        stamps = rng.sample(range(-3000, 60_000), count)
        for t in stamps:
            rows.append(sample(run, t / 1000, None if rng.random() < 0.2 else rng.uniform(50, 300), None if rng.random() < 0.3 else rng.uniform(0, 900)))
        runs.append((run, wall, 10, 5, 5))
    for width in (0.7, 5.0, 1e9):
        found = summary(spark, rows, runs, segment_seconds=width)
        for run, wall, *_ in runs:
            energy, count, delta, peak = brute([r for r in rows if r[0] == run], wall)
            got = found[run]
            assert math.isclose(got.energy_j, energy, rel_tol=1e-9, abs_tol=1e-9) and got.sample_count == count
            assert got.peak_delta_mib == delta and got.peak_w == peak
    plain = tm.energy_trapezoid(spark.createDataFrame(rows, SCHEMA), ["run_id"], segment_seconds=0.9)
    wide = tm.energy_trapezoid(spark.createDataFrame(rows, SCHEMA).repartition(9), ["run_id"], segment_seconds=1e9)
    both = plain.join(wide.withColumnRenamed("energy_j", "e"), "run_id").collect()
    assert len(both) == 4 and all(math.isclose(r.energy_j, r.e, rel_tol=1e-9) for r in both)


def test_cpu_usage(spark):
    before = spark.createDataFrame([("a", 10.0, 2.0), ("b", 5.0, 1.0)], "run_id string, user_time_sec double, system_time_sec double")
    after = spark.createDataFrame([("a", 120.0, 27.0, 100.0, 16), ("b", 4.0, 2.0, 100.0, 16)],
                                  "run_id string, user_time_sec double, system_time_sec double, wall_time_sec double, logical_cpus int")
    out = {r.run_id: r for r in tm.cpu_usage(tm.counter_delta(before, after, ["run_id"], ["user_time_sec", "system_time_sec"])).collect()}
    assert (out["a"].total_time_sec, out["a"].average_cores, out["a"].capacity_percent) == (135.0, 1.35, 8.4375)
    assert out["b"].errors == ["counters moved backwards"]


def test_lifecycle(spark):
    s = 1_000_000_000
    df = spark.createDataFrame(
        [(1 * s, 13 * s, 2 * s, 11 * s, 10, "x", 10), (1 * s, 3 * s, 5 * s, 4 * s, 0, "", 10)],
        "process_started_ns long, process_finished_ns long, first_frame_completed_ns long, last_frame_completed_ns long, processed_frames int, instrumentation string, expected_frames int")
    good, bad = tm.lifecycle_scopes(df).orderBy(F.desc("processed_frames")).collect()
    assert (good.startup_sec, good.steady_state_frame_loop_sec, good.finalize_mux_sec, good.total_sec, good.steady_state_frames, good.errors) == (1, 9, 2, 12, 9, [])
    assert "last frame precedes first frame" in bad.errors and "frame count mismatch" in bad.errors


def test_bitmask(spark):
    df = spark.createDataFrame([(0,), (0x4 | 0x8,), (None,)], "m long")
    out = {r.m: r.n for r in df.select("m", tm.decode_bitmask(F.col("m")).alias("n")).collect()}
    assert out == {0: [], 12: ["hw_slowdown", "sw_power_cap"], None: []}


def test_a_hot_run_is_spread_even_after_a_shuffled_join(spark):
    """A join on the run alone must not leave the window of a whole run in one task."""
    samples = spark.createDataFrame([sample("hot", float(t)) for t in range(50)] + [sample("b", 1.0)], SCHEMA)
    runs = spark.createDataFrame([("hot", 40.0, 10, 1, 0), ("b", 2.0, 10, 1, 0)], RUNS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tm.window_metrics(samples, runs, ["run_id"], segment_seconds=5.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        spread = [line for line in plan.splitlines() if "hashpartitioning(run_id" in line and "_segment" in line]
        assert spread and {r.run_id: r.energy_j for r in out.collect()} == {"hot": 4000.0, "b": 200.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
