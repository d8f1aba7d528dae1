"""Telemetry queries: each user is a run, its events are the device samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import telemetry as tm
from fleetgauge.operators.quantiles import exact_quantiles
from fleetgauge.operators.sequence import phase_intervals, rebase_time
from fleetgauge.plans.manifests import errors_sql
from fleetgauge.plans.registry import micros, query, rounded

c = F.col
KEYS = ["run_id"]
DAY = 86_400.0
DAY_US = 86_400 * 1_000_000

# The run starts a tenth after the first event and lasts eight tenths of the whole span.
SAMPLES = """
raw AS (SELECT user_id AS run_id, epoch_us(ts) AS us, value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
runs AS (SELECT run_id, lo + (hi - lo) // 10 AS origin_us, ((hi - lo) * 8 // 10) / 1e6 AS wall_time_sec, 100 + run_id % 7 AS frames,
   run_id % 3 AS max_compute, 0 AS max_graphics FROM (SELECT run_id, min(us) AS lo, max(us) AS hi FROM raw GROUP BY run_id)),
samples AS (SELECT run_id, (us - origin_us) / 1e6 AS t, CASE WHEN k >= 5 THEN value END AS power_w, CASE WHEN k % 10 > 0 THEN k * 10.0 END AS mem,
   CASE WHEN k <> 50 THEN k END AS util, 30 + k % 50 AS temp, CASE WHEN k <= 95 THEN 1000 + k * 5 END AS gclk, 5000 + k AS mclk,
   CASE WHEN k = 99 AND run_id % 4 = 0 THEN 400.0 WHEN k > 1 THEN 350.0 END AS plimit, CASE WHEN k % 9 > 0 THEN k % 3 END AS comp, CASE WHEN k % 40 = 1 THEN 1 ELSE 0 END AS graph,
   event_type FROM raw JOIN runs USING (run_id)),
edges AS (SELECT run_id, wall_time_sec, count(*) FILTER (t <= 0) AS nb, count(*) FILTER (t >= wall_time_sec) AS na, max(t) FILTER (t <= 0) AS tb, min(t) AS t0, min(t) FILTER (t >= wall_time_sec) AS ta, max(t) AS t1
   FROM samples JOIN runs USING (run_id) GROUP BY ALL),
bounded AS (
  SELECT s.* FROM samples s JOIN runs r USING (run_id) WHERE s.t > 0 AND s.t < r.wall_time_sec
  UNION ALL SELECT s.* REPLACE (0.0 AS t) FROM samples s JOIN edges e ON e.run_id = s.run_id AND s.t = coalesce(e.tb, e.t0)
  UNION ALL SELECT s.* REPLACE (e.wall_time_sec AS t) FROM samples s JOIN edges e ON e.run_id = s.run_id AND s.t = coalesce(e.ta, e.t1)),
energy AS (SELECT run_id, coalesce(sum(CASE WHEN t > pt THEN (t - pt) * (power_w + pp) / 2 END), 0) AS energy_j FROM (
   SELECT run_id, t, power_w, lag(t) OVER w AS pt, lag(power_w) OVER w AS pp FROM bounded WHERE power_w IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY t)) GROUP BY run_id)"""
WITH = "WITH " + SAMPLES + " "

# Throttle reasons that stand for each event type.
REASONS = {
    "click": ("gpu_idle",), "view": (), "purchase": ("sw_power_cap",),
    "signup": ("hw_slowdown", "sw_power_cap"), "error": ("sync_boost",),
}


def runs_and_samples(t):
    """(runs, samples) in the native sample schema."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = t.events.select(c("user_id").alias("run_id"), micros().alias("us"), "value", "event_type", k.alias("k"))
    lo, hi = c("lo"), c("hi")
    run = c("run_id")
    runs = raw.groupBy("run_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).select(
        "run_id",
        (lo + F.floor((hi - lo) / 10)).cast("long").alias("origin_us"),
        (F.floor((hi - lo) * 8 / 10) / 1e6).alias("wall_time_sec"),
        (100 + run % 7).alias("frames"),
        (run % 3).alias("max_compute_processes"),
        F.lit(0).cast("long").alias("max_graphics_processes"),
    )
    reasons = F.array().cast("array<string>")
    for event, names in REASONS.items():
        if names:
            reasons = F.when(c("event_type") == event, F.array(*[F.lit(n) for n in names])).otherwise(reasons)
    k = c("k")
    rebased = rebase_time(raw, runs, KEYS, "us", "origin_us", "us")
    samples = rebased.select(
        "run_id", (c("us") / 1e6).alias("relative_sec"),
        F.when(k >= 5, c("value")).alias("power_w"),
        F.when(k % 10 > 0, k * 10.0).alias("memory_used_mib"),
        F.when(k != 50, k).alias("gpu_utilization_percent"),
        (30 + k % 50).alias("temperature_c"),
        F.when(k <= 95, 1000 + k * 5).alias("graphics_clock_mhz"),
        (5000 + k).alias("memory_clock_mhz"),
        F.when((k == 99) & (run % 4 == 0), 400.0).when(k > 1, 350.0).alias("power_limit_w"),
        F.when(k % 9 > 0, k % 3).alias("compute_process_count"),
        F.when(k % 40 == 1, 1).otherwise(0).cast("long").alias("graphics_process_count"),
        reasons.alias("throttle_reasons"),
    )
    return runs, samples


def clipped(t):
    runs, samples = runs_and_samples(t)
    return runs, tm.clip_to_window(samples, runs, KEYS)


def measured(t, *parts):
    runs, samples = runs_and_samples(t)
    return tm.window_metrics(samples, runs, KEYS, parts, segment_seconds=5 * DAY)


@query("W15_rebase_time", WITH + "SELECT run_id, round(t, 6) AS relative_sec, power_w FROM samples")
def _w15(t):
    return rounded(runs_and_samples(t)[1].select("run_id", "relative_sec", "power_w"))


@query("J09_boundary_asof", WITH + """SELECT e.run_id, round(coalesce(e.tb, e.t0), 6) AS start_sec, a.power_w AS start_w, round(coalesce(e.ta, e.t1), 6) AS end_sec, b.power_w AS end_w
FROM edges e JOIN samples a ON a.run_id = e.run_id AND a.t = coalesce(e.tb, e.t0) JOIN samples b ON b.run_id = e.run_id AND b.t = coalesce(e.ta, e.t1)""")
def _j09(t):
    runs, samples = runs_and_samples(t)
    windows = runs.select("run_id", F.lit(0.0).alias("lo"), c("wall_time_sec").alias("hi"))
    edges = tm.boundary_asof(samples, windows, KEYS, "relative_sec", "lo", "hi")
    return rounded(edges.select(
        "run_id", c("at_start.relative_sec").alias("start_sec"), c("at_start.power_w").alias("start_w"),
        c("at_end.relative_sec").alias("end_sec"), c("at_end.power_w").alias("end_w"),
    ))


@query("A05_clip_to_window", WITH + "SELECT run_id, round(t, 6) AS relative_sec, power_w, mem AS memory_used_mib FROM bounded", memory_used_mib="DOUBLE")
def _a05(t):
    return rounded(clipped(t)[1].select("run_id", "relative_sec", "power_w", "memory_used_mib"))


@query("A06_energy_trapezoid", WITH + "SELECT run_id, round(energy_j, 3) AS energy_j FROM energy")
def _a06(t):
    return rounded(tm.energy_trapezoid(clipped(t)[1], KEYS, segment_seconds=5 * DAY), 3)


@query("A07_power_summary", WITH + """SELECT r.run_id, round(energy_j, 3) AS energy_j, round(energy_j / wall_time_sec, 6) AS average_w, round(energy_j / frames, 3) AS joules_per_frame,
 (SELECT max(power_w) FROM bounded b WHERE b.run_id = r.run_id) AS peak_w, (SELECT bool_or(event_type IN ('purchase', 'signup')) FROM bounded b WHERE b.run_id = r.run_id) AS power_cap_observed
FROM runs r JOIN energy USING (run_id)""")
def _a07(t):
    runs, _ = runs_and_samples(t)
    found = measured(t, "power", "throttle")
    out = runs.join(found, KEYS).withColumns(tm.power_columns())
    return out.select(
        "run_id", F.round("energy_j", 3).alias("energy_j"), F.round("average_w", 6).alias("average_w"),
        F.round("joules_per_frame", 3).alias("joules_per_frame"), "peak_w", "power_cap_observed",
    )


@query("A08_memory_summary", WITH + """SELECT run_id, arg_min(mem, t) FILTER (mem IS NOT NULL) AS baseline_used_mib, max(mem) AS peak_used_mib,
 greatest(0.0, max(mem) - arg_min(mem, t) FILTER (mem IS NOT NULL)) AS peak_delta_mib FROM bounded GROUP BY run_id""", peak_used_mib="DOUBLE", baseline_used_mib="DOUBLE", peak_delta_mib="DOUBLE")
def _a08(t):
    found = measured(t, "memory")
    return found.withColumn("peak_delta_mib", tm.peak_delta())


@query("A09_utilisation_summary", WITH + "SELECT run_id, round(avg(util), 8) AS average_gpu_percent, max(util) AS peak_gpu_percent FROM bounded GROUP BY run_id")
def _a09(t):
    return rounded(measured(t, "utilization"), 8)


@query("A10_temperature_summary", WITH + "SELECT run_id, arg_min(temp, t) AS start_c, max(temp) AS peak_c FROM bounded GROUP BY run_id")
def _a10(t):
    return measured(t, "temperature")


@query("A11_clock_ranges", WITH + """SELECT run_id, min(gclk) AS graphics_min_mhz, max(gclk) AS graphics_max_mhz, min(mclk) AS memory_min_mhz, max(mclk) AS memory_max_mhz FROM bounded GROUP BY run_id""")
def _a11(t):
    return measured(t, "clocks")


PROCESS = """proc AS (SELECT run_id, count(*) AS n, arg_min(coalesce(comp, -1), t) AS bc, arg_min(graph, t) AS bg, max(comp) AS mc, max(graph) AS mg FROM bounded GROUP BY run_id)"""
PROCESS_RULES = [
    ("another compute process was active before the run", "bc > 0"),
    ("a graphics process was active", "bg > 0"),
    ("compute process accounting is unavailable", "mc IS NULL"),
    ("graphics process accounting is unavailable", "mg IS NULL"),
    ("compute process count exceeded its limit: at most ' || max_compute || ', got ' || mc || '", "mc > max_compute"),
    ("graphics process count exceeded its limit: at most ' || max_graphics || ', got ' || mg || '", "mg > max_graphics"),
]


@query("A12_process_limits", WITH + f", {PROCESS} SELECT run_id, mc AS max_compute_count, mg AS max_graphics_count, {errors_sql(*PROCESS_RULES)} AS errors FROM proc JOIN runs USING (run_id)", max_graphics_count="BIGINT")
def _a12(t):
    from fleetgauge.functions import rules as R

    runs, _ = runs_and_samples(t)
    found = measured(t, "processes").join(runs, KEYS)
    errors = R.labels(tm.process_rules(c("max_compute_processes"), c("max_graphics_processes")))
    return found.select("run_id", "max_compute_count", "max_graphics_count", F.array_join(errors, "; ").alias("errors"))


REASON_SQL = """reasons AS (SELECT DISTINCT run_id, unnest(CASE event_type WHEN 'click' THEN ['gpu_idle'] WHEN 'purchase' THEN ['sw_power_cap']
  WHEN 'signup' THEN ['hw_slowdown', 'sw_power_cap'] WHEN 'error' THEN ['sync_boost'] END) AS reason FROM bounded)"""


@query("A13_throttle_sets", WITH + f""", {REASON_SQL} SELECT r.run_id, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons,
 coalesce(string_agg(reason, ',' ORDER BY reason) FILTER (reason = 'hw_slowdown'), '') AS invalid FROM runs r LEFT JOIN reasons USING (run_id) GROUP BY r.run_id""")
def _a13(t):
    found = measured(t, "throttle")
    bad = F.array_intersect("throttle_reasons", F.array(*[F.lit(r) for r in tm.INVALID_REASONS]))
    return found.select(
        "run_id", F.array_join("throttle_reasons", ",").alias("reasons"), F.array_join(F.array_sort(bad), ",").alias("invalid")
    )


@query("A14_decode_bitmask", """
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 5 AS m FROM events),
b AS (SELECT * FROM (VALUES ('gpu_idle', 1), ('applications_clocks_setting', 2), ('sw_power_cap', 4), ('hw_slowdown', 8), ('sync_boost', 16), ('sw_thermal_slowdown', 32), ('hw_thermal_slowdown', 64), ('hw_power_brake_slowdown', 128), ('display_clock_setting', 256)) v(name, bit))
SELECT event_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS reasons FROM e LEFT JOIN b ON (m & bit) <> 0 GROUP BY event_id""")
def _a14(t):
    mask = F.get_json_object("props", "$.k").cast("long") * 5
    return t.events.select("event_id", F.array_join(tm.decode_bitmask(mask), ",").alias("reasons"))


@query("A15_distinct_process_count", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS processes FROM orders GROUP BY 1")
def _a15(t):
    return tm.distinct_process_count(t.orders, ["o_orderpriority"], "o_custkey")


@query("A16_sampling_interval", WITH + """SELECT run_id, count(*) AS sample_count, round(1000 * max(wall_time_sec) / (count(*) - 1), 3) AS interval_ms FROM bounded JOIN runs USING (run_id) GROUP BY run_id""")
def _a16(t):
    runs, _ = runs_and_samples(t)
    found = measured(t, "count").join(runs, KEYS)
    return found.select("run_id", "sample_count", F.round(tm.observed_interval_ms(), 3).alias("interval_ms"))


@query("A17_telemetry_summary", WITH + f""", {PROCESS}, {REASON_SQL},
thr AS (SELECT run_id, string_agg(reason, ',' ORDER BY reason) AS reasons, bool_or(reason = 'sw_power_cap') AS cap, bool_or(reason = 'hw_slowdown') AS hw FROM reasons GROUP BY run_id),
agg AS (SELECT run_id, count(*) AS sample_count, max(power_w) AS peak_w, count(power_w) AS np, arg_min(mem, t) FILTER (mem IS NOT NULL) AS m0, max(mem) AS m1, avg(util) AS ua, max(util) AS up,
  arg_min(temp, t) AS c0, max(temp) AS c1, min(gclk) AS g0, max(gclk) AS g1, min(mclk) AS k0, max(mclk) AS k1, min(plimit) AS l0, max(plimit) AS l1 FROM bounded GROUP BY run_id)
SELECT r.run_id, sample_count, round(1000 * wall_time_sec / (sample_count - 1), 3) AS sample_interval_observed_ms, round(energy_j, 3) AS energy_j, round(energy_j / wall_time_sec, 6) AS average_w,
 round(energy_j / frames, 3) AS joules_per_frame, peak_w, coalesce(cap, false) AS power_cap_observed, CASE WHEN l0 = l1 THEN l0 END AS limit_w, m0 AS baseline_used_mib, m1 AS peak_used_mib,
 greatest(0.0, m1 - m0) AS peak_delta_mib, round(ua, 6) AS average_gpu_percent, up AS peak_gpu_percent, c0 AS start_c, c1 AS peak_c, g0 AS graphics_min_mhz, g1 AS graphics_max_mhz,
 k0 AS memory_min_mhz, k1 AS memory_max_mhz, mc AS max_compute_count, mg AS max_graphics_count, coalesce(reasons, '') AS throttle_reasons,
 {errors_sql(('power sampling requires at least two samples', 'np < 2'), ('memory usage is unavailable', 'm1 IS NULL'), ('invalid throttle reasons observed: hw_slowdown', 'hw'), *PROCESS_RULES,
 ('power limit is unavailable', 'l0 IS NULL'), ('power limit changed during the run', 'l0 <> l1'), ('utilization sampling is unavailable', 'up IS NULL'), ('clock sampling is unavailable', 'g1 IS NULL'))} AS errors
FROM runs r JOIN agg USING (run_id) JOIN proc USING (run_id) LEFT JOIN energy USING (run_id) LEFT JOIN thr USING (run_id)""", limit_w="DOUBLE", baseline_used_mib="DOUBLE", peak_used_mib="DOUBLE", peak_delta_mib="DOUBLE", max_graphics_count="BIGINT")
def _a17(t):
    runs, samples = runs_and_samples(t)
    out = tm.telemetry_summary(samples, runs, KEYS, segment_seconds=5 * DAY)
    return out.select(
        "run_id", "sample_count", F.round("sample_interval_observed_ms", 3).alias("sample_interval_observed_ms"),
        F.round("energy_j", 3).alias("energy_j"), F.round("average_w", 6).alias("average_w"),
        F.round("joules_per_frame", 3).alias("joules_per_frame"), "peak_w", "power_cap_observed", "limit_w",
        "baseline_used_mib", "peak_used_mib", "peak_delta_mib", F.round("average_gpu_percent", 6).alias("average_gpu_percent"),
        "peak_gpu_percent", "start_c", "peak_c", "graphics_min_mhz", "graphics_max_mhz", "memory_min_mhz", "memory_max_mhz",
        "max_compute_count", "max_graphics_count", F.array_join("throttle_reasons", ",").alias("throttle_reasons"),
        F.array_join("errors", "; ").alias("errors"),
    )


# First and last order of a customer as cumulative counters (price in cents).
SNAPSHOTS = """
o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, epoch_us(o_orderdate) // 1000000 AS day FROM orders),
s AS (SELECT o_custkey AS run_id, arg_min(cents, (day, o_orderkey)) AS u0, arg_max(cents, (day, o_orderkey)) AS u1, min(day) AS w0, max(day) AS w1 FROM o GROUP BY 1)"""


def snapshots(t):
    cents = F.round(c("o_totalprice") * 100).cast("long")
    at = F.struct("day", "o_orderkey")
    both = t.orders.select("o_custkey", "o_orderkey", cents.alias("cents"), F.floor(micros("o_orderdate") / 1_000_000).cast("long").alias("day"))
    ends = both.groupBy(c("o_custkey").alias("run_id")).agg(
        F.min_by("cents", at).alias("u0"), F.max_by("cents", at).alias("u1"), F.min("day").alias("w0"), F.max("day").alias("w1"))
    before = ends.select("run_id", (c("u0") / 100.0).alias("user_time_sec"), c("w0").alias("system_time_sec"))
    after = ends.select(
        "run_id", (c("u1") / 100.0).alias("user_time_sec"), c("w1").alias("system_time_sec"),
        (c("w1") - c("w0")).cast("double").alias("wall_time_sec"), (c("run_id") % 8).cast("int").alias("logical_cpus"))
    return before, after


@query("J10_counter_delta", f"""WITH {SNAPSHOTS} SELECT run_id, round(u1 / 100.0 - u0 / 100.0, 4) AS user_time_sec, w1 - w0 AS system_time_sec,
 CASE WHEN u1 < u0 THEN 'counters moved backwards' ELSE '' END AS errors FROM s""")
def _j10(t):
    out = tm.counter_delta(*snapshots(t), KEYS, ["user_time_sec", "system_time_sec"])
    return out.select("run_id", F.round("user_time_sec", 4).alias("user_time_sec"), "system_time_sec", F.array_join("errors", "; ").alias("errors"))


@query("A18_cpu_usage", f"""WITH {SNAPSHOTS}, d AS (SELECT run_id, (u1 / 100.0 - u0 / 100.0) + (w1 - w0) AS total, CAST(w1 - w0 AS DOUBLE) AS wall, run_id % 8 AS cpus FROM s)
SELECT run_id, round(total, 4) AS total_time_sec, round(CASE WHEN wall > 0 THEN total / wall END, 6) AS average_cores, round(CASE WHEN wall > 0 AND cpus > 0 THEN total / wall / cpus * 100 END, 6) AS capacity_percent FROM d""")
def _a18(t):
    out = tm.cpu_usage(tm.counter_delta(*snapshots(t), KEYS, ["user_time_sec", "system_time_sec"]))
    return out.select("run_id", F.round("total_time_sec", 4).alias("total_time_sec"), F.round("average_cores", 6).alias("average_cores"),
                      F.round("capacity_percent", 6).alias("capacity_percent"))


MARKS = """
marks AS (SELECT user_id AS run_id, min(epoch_us(ts)) FILTER (event_type = 'click') AS a, min(epoch_us(ts)) FILTER (event_type = 'view') AS f,
  max(epoch_us(ts)) FILTER (event_type = 'view') AS l, max(epoch_us(ts)) FILTER (event_type <> 'view') AS z, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY user_id)"""


def markers(t):
    us, kind = micros(), c("event_type")
    return t.events.groupBy(c("user_id").alias("run_id")).agg(
        (F.min(F.when(kind == "click", us)) * 1000).alias("process_started_ns"),
        (F.min(F.when(kind == "view", us)) * 1000).alias("first_frame_completed_ns"),
        (F.max(F.when(kind == "view", us)) * 1000).alias("last_frame_completed_ns"),
        (F.max(F.when(kind != "view", us)) * 1000).alias("process_finished_ns"),
        F.count_if(kind == "view").alias("processed_frames"),
    ).withColumns({"instrumentation": F.lit("events"), "expected_frames": c("processed_frames") - c("run_id") % 2})


@query("A19_lifecycle_scopes", f"""WITH {MARKS} SELECT run_id, round((f - a) / 1e6, 6) AS startup_sec, round((l - f) / 1e6, 6) AS steady_state_frame_loop_sec, round((z - l) / 1e6, 6) AS finalize_mux_sec,
 round((z - a) / 1e6, 6) AS total_sec, greatest(0, n - 1) AS steady_state_frames, {errors_sql(('expected frame count must be positive', 'n - run_id % 2 <= 0'), ('frame count mismatch', 'run_id % 2 = 1'), ('process duration must be positive', 'z <= a'),
 ('first frame precedes process', 'f < a'), ('last frame follows process', 'l > z'))} AS errors FROM marks""")
def _a19(t):
    out = tm.lifecycle_scopes(markers(t))
    return rounded(out.select(
        "run_id", "startup_sec", "steady_state_frame_loop_sec", "finalize_mux_sec", "total_sec", "steady_state_frames",
        F.array_join("errors", "; ").alias("errors"),
    ))


CHECKPOINTS = """
cp AS (SELECT user_id AS run_id, event_type AS name, min(epoch_us(ts)) AS us FROM events GROUP BY 1, 2),
steps AS (SELECT run_id, lag(name) OVER w || '_to_' || name AS interval, us - lag(us) OVER w AS length, us FROM cp WINDOW w AS (PARTITION BY run_id ORDER BY us, name)),
bounds AS (SELECT user_id AS run_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - 86400000000 AS hi FROM events GROUP BY 1)"""


def phases(t):
    points = t.events.groupBy(c("user_id").alias("run_id"), c("event_type").alias("name")).agg(F.min(micros()).alias("us"))
    bounds = t.events.groupBy(c("user_id").alias("run_id")).agg(F.min(micros()).alias("lo"), (F.max(micros()) - DAY_US).alias("hi"))
    return phase_intervals(points.join(bounds, KEYS), KEYS, "name", "us", "lo", "hi", 2 * DAY_US)


@query("W05_phase_intervals", f"""WITH {CHECKPOINTS} SELECT run_id, interval, length, us < lo OR us > hi AS outside FROM steps JOIN bounds USING (run_id) WHERE interval IS NOT NULL""")
def _w05(t):
    return phases(t)


@query("A20_median_phase_intervals", f"""WITH {CHECKPOINTS}, n AS (SELECT run_id, run_id % 10 AS suite, string_agg(interval, ',' ORDER BY interval) AS names FROM steps WHERE interval IS NOT NULL GROUP BY 1),
same AS (SELECT suite, count(DISTINCT names) = 1 AS same_names FROM n GROUP BY suite),
med AS (SELECT run_id % 10 AS suite, interval, round(median(length), 3) AS median_us FROM steps WHERE interval IS NOT NULL GROUP BY 1, 2)
SELECT suite, interval, median_us, same_names FROM med JOIN same USING (suite)""")
def _a20(t):
    from fleetgauge.operators.stats import median_phase_intervals

    data = phases(t).withColumn("suite", c("run_id") % 10)
    return rounded(median_phase_intervals(data, ["suite"], "run_id", "interval", "length", "median_us"), 3)
