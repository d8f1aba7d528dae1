"""Statistics queries: a supplier is a campaign, a return flag an implementation, a line number a round."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators import stats as st
from fleetgauge.operators.segments import by_width, row_numbers
from fleetgauge.plans.manifests import errors_sql
from fleetgauge.plans.registry import micros, query, rounded

c = F.col
GROUP = ["campaign", "implementation"]

RUNS = """
runs AS (SELECT l_suppkey AS campaign, l_returnflag AS implementation, l_linenumber AS round, count(*) AS n,
  sum(CAST(l_quantity AS BIGINT)) / count(*) AS fps, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS wall,
  sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS cores, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) + 1 AS vram
  FROM lineitem GROUP BY 1, 2, 3),
suites AS (SELECT campaign, implementation, count(*) AS runs, median(fps) AS median_fps, min(fps) AS min_fps, max(fps) AS max_fps, (max(fps) - min(fps)) / median(fps) AS relative_spread,
  median(wall) AS wall, median(cores) AS cores, median(vram) AS vram FROM runs GROUP BY 1, 2)"""
WITH = f"WITH {RUNS} "


def runs(t):
    return runs_of(t.lineitem)


def runs_of(lines):
    whole = lambda name, k: F.sum(F.round(c(name) * k).cast("long")) / F.count("*")
    return lines.groupBy(
        c("l_suppkey").alias("campaign"), c("l_returnflag").alias("implementation"), c("l_linenumber").alias("round")
    ).agg(
        F.count("*").alias("n"), whole("l_quantity", 1).alias("fps"), (whole("l_extendedprice", 100) / 100).alias("wall"),
        whole("l_tax", 100).alias("cores"), (whole("l_discount", 100) + 1).alias("vram"),
    )


@query("A01_suite_statistics", WITH + "SELECT campaign, implementation, runs, round(median_fps, 8) AS median_fps, round(min_fps, 8) AS min_fps, round(max_fps, 8) AS max_fps, round(relative_spread, 8) AS relative_spread FROM suites")
def _a01(t):
    return rounded(st.suite_statistics(runs(t), GROUP, "fps"), 8)


@query("A01b_suite_values", WITH + "SELECT campaign, implementation, round, round(fps, 8) AS fps, round(median_fps, 8) AS median_fps, round(relative_spread, 8) AS relative_spread FROM runs JOIN suites USING (campaign, implementation)")
def _a01b(t):
    found = st.suite_values(runs(t), GROUP, "fps")
    return rounded(found.select(*GROUP, "round", "fps", "median_fps", "relative_spread"), 8)


@query("A02_needs_extension", WITH + "SELECT campaign, implementation, relative_spread > 0.25 AS extend FROM suites")
def _a02(t):
    return st.needs_extension(st.suite_statistics(runs(t), GROUP, "fps"), 0.25).select(*GROUP, "extend")


@query("A03_suite_status", WITH + """,
v AS (SELECT *, CASE WHEN n % 3 > 0 THEN CASE WHEN campaign % 7 = 0 THEN 350 + round ELSE 350 END END AS plimit, NOT (campaign % 5 = 0 AND round = 4) AS ok FROM runs),
e AS (SELECT campaign, implementation, (max(fps) - min(fps)) / median(fps) AS early FROM v WHERE ok AND round <= 3 GROUP BY 1, 2),
w AS (SELECT campaign, implementation, median(fps) AS med, (max(fps) - min(fps)) / median(fps) AS spread FROM v WHERE ok GROUP BY 1, 2),
k AS (SELECT campaign, implementation, count(*) AS n, bool_and(ok) AS al, count(DISTINCT plimit) FILTER (ok) <= 1 AS same FROM v GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN early > 0.1 THEN 5 ELSE 3 END AS target FROM k LEFT JOIN e USING (campaign, implementation) LEFT JOIN w USING (campaign, implementation))
SELECT campaign, implementation, n AS runs, target AS target_runs, round(med, 8) AS median_fps, round(spread, 8) AS relative_spread,
 CASE WHEN al AND same AND n = target THEN CASE WHEN spread <= 0.25 THEN 'valid' ELSE 'unstable' END ELSE 'invalid' END AS status FROM q""")
def _a03(t):
    data = runs(t).withColumns({
        "run_index": c("round"),
        "plimit": F.when(c("n") % 3 > 0, F.when(c("campaign") % 7 == 0, 350 + c("round")).otherwise(350)),
    })
    valid = ~((c("campaign") % 5 == 0) & (c("round") == 4))
    return rounded(st.suite_status(data, GROUP, "fps", valid, "plimit", 3, 2, 0.1, 0.25), 8)


@query("A04_constant_per_group", """SELECT l_orderkey, count(DISTINCT nullif(l_linestatus, 'X')) <= 1 AS constant FROM lineitem GROUP BY 1""")
def _a04(t):
    from fleetgauge.operators.telemetry import constant_per_group

    return constant_per_group(t.lineitem, ["l_orderkey"], "l_linestatus")


@query("A21_implementation_statistics", WITH + "SELECT campaign, implementation, runs, round(median_fps, 8) AS median_fps, round(min_fps, 8) AS min_fps, round(max_fps, 8) AS max_fps, round(relative_spread, 8) AS relative_spread, round(wall, 6) AS median_wall_time_sec, round(cores, 8) AS median_cpu_cores, round(vram, 8) AS median_peak_vram_mib FROM suites")
def _a21(t):
    names = {"median_wall_time_sec": "wall", "median_cpu_cores": "cores", "median_peak_vram_mib": "vram"}
    found = st.implementation_statistics(runs(t), GROUP, "fps", names)
    return rounded(found.withColumn("median_wall_time_sec", F.round("median_wall_time_sec", 6)), 8)


# Lines are dealt to three or five rounds; some campaigns keep up to seven and are incomplete.
STABLE = """
five AS (SELECT l_suppkey AS campaign, l_returnflag AS implementation, CASE WHEN l_suppkey % 7 = 1 THEN l_linenumber ELSE (l_linenumber - 1) % (CASE WHEN l_suppkey % 3 = 0 THEN 3 ELSE 5 END) + 1 END AS round,
  sum(CAST(l_quantity AS BIGINT)) / count(*) AS fps FROM lineitem GROUP BY 1, 2, 3),
fl AS (SELECT campaign, implementation, count(*) AS rounds, max(round) = count(*) AND count(*) IN (3, 5) AS usable, (max(fps) - min(fps)) / median(fps) AS full_spread FROM five GROUP BY 1, 2),
lo AS (SELECT a.campaign, a.implementation, x.round AS ex, (max(a.fps) - min(a.fps)) / median(a.fps) AS sp FROM five a JOIN five x ON a.campaign = x.campaign AND a.implementation = x.implementation AND a.round <> x.round GROUP BY 1, 2, 3),
best AS (SELECT campaign, implementation, arg_min(ex, (sp, -ex)) AS ex, min(sp) AS sp FROM lo GROUP BY 1, 2),
verdict AS (SELECT campaign, implementation, rounds, CASE WHEN usable THEN full_spread END AS full_spread, CASE WHEN usable AND rounds = 5 AND full_spread > 0.2 THEN sp END AS consensus_spread, CASE WHEN usable AND rounds = 5 AND full_spread > 0.2 AND sp <= 0.2 THEN ex END AS outlier_round,
 CASE WHEN NOT usable THEN 'incomplete' WHEN full_spread <= 0.2 THEN 'stable' WHEN rounds = 3 THEN 'needs-extra-runs' WHEN sp <= 0.2 THEN 'stable-with-one-outlier' ELSE 'unstable' END AS stability FROM fl LEFT JOIN best USING (campaign, implementation))"""


def verdicts(t):
    turn = (c("l_linenumber") - 1) % F.when(c("l_suppkey") % 3 == 0, 3).otherwise(5) + 1
    dealt = t.lineitem.withColumn("l_linenumber", F.when(c("l_suppkey") % 7 == 1, c("l_linenumber")).otherwise(turn))
    return st.stability(runs_of(dealt), GROUP, "round", "fps", 0.2)


@query("A23_stability", WITH + f", {STABLE} SELECT campaign, implementation, rounds, round(full_spread, 8) AS full_spread, round(consensus_spread, 8) AS consensus_spread, outlier_round, stability FROM verdict")
def _a23(t):
    return rounded(verdicts(t), 8)


@query("A22_campaign_summary", WITH + f""", {STABLE}, g AS (SELECT campaign, max(rounds) AS rounds, count(*) FILTER (stability IN ('needs-extra-runs', 'unstable', 'incomplete')) AS bad, count(*) FILTER (stability = 'stable-with-one-outlier') AS warnings, campaign % 2 AS gaps FROM verdict GROUP BY campaign),
s AS (SELECT *, CASE WHEN bad > 0 AND rounds = 3 THEN 'needs-extra-runs' WHEN bad > 0 THEN 'unstable' ELSE 'valid' END AS status FROM g)
SELECT campaign, rounds, bad AS unstable_implementations, warnings, gaps, status, status = 'valid' AND gaps = 0 AS publishable FROM s""")
def _a22(t):
    return st.campaign_summary(verdicts(t), ["campaign"], c("campaign") % 2)


@query("J11_relative_to_baseline", WITH + """SELECT s.campaign, s.implementation, round((s.median_fps / b.median_fps - 1) * 100, 6) AS relative_percent FROM suites s LEFT JOIN suites b ON b.campaign = s.campaign AND b.implementation = 'A'""")
def _j11(t):
    suites = st.suite_statistics(runs(t), GROUP, "fps")
    found = st.relative_to_baseline(suites, ["campaign"], "implementation", "A", "median_fps")
    return rounded(found.select(*GROUP, "relative_percent"))


FASTEST = """
oth AS (SELECT campaign, arg_max(implementation, (median_fps, implementation)) AS fastest FROM suites WHERE implementation <> 'A' GROUP BY 1),
fast AS (SELECT b.campaign, o.implementation AS fastest, o.median_fps AS fastest_fps, (b.median_fps / o.median_fps - 1) * 100 AS delta_percent, o.cores / b.cores AS cores_ratio, o.vram / b.vram AS vram_ratio
 FROM suites b JOIN oth USING (campaign) JOIN suites o ON o.campaign = b.campaign AND o.implementation = oth.fastest WHERE b.implementation = 'A')"""


def fastest(t):
    suites = st.implementation_statistics(runs(t), GROUP, "fps", {"cores": "cores", "vram": "vram"})
    return st.fastest_other(suites, ["campaign"], "implementation", "A", "median_fps", ["cores", "vram"])


@query("J12_fastest_other", WITH + f", {FASTEST} SELECT campaign, fastest, round(fastest_fps, 8) AS fastest_fps, round(delta_percent, 6) AS delta_percent, round(cores_ratio, 8) AS cores_ratio, round(vram_ratio, 8) AS vram_ratio FROM fast")
def _j12(t):
    return rounded(fastest(t).withColumn("delta_percent", F.round("delta_percent", 6)), 8)


@query("A40_cost_ratios", WITH + f", {FASTEST} SELECT s_nationkey AS nation, round(min(cores_ratio), 8) AS min_cores, round(max(cores_ratio), 8) AS max_cores, round(min(vram_ratio), 8) AS min_vram, round(max(vram_ratio), 8) AS max_vram FROM fast JOIN supplier ON s_suppkey = campaign GROUP BY 1")
def _a40(t):
    placed = fastest(t).join(t.supplier, c("campaign") == c("s_suppkey")).select(
        c("s_nationkey").alias("nation"), c("cores_ratio").alias("cores"), c("vram_ratio").alias("vram"))
    return rounded(st.cost_ratios(placed, ["nation"], ["cores", "vram"]), 8)


@query("A41_parity_class", WITH + f", {FASTEST} SELECT campaign, CASE WHEN delta_percent > 5 THEN 'advantage' WHEN delta_percent < -5 THEN 'loss' ELSE 'parity' END AS class FROM fast")
def _a41(t):
    return fastest(t).select("campaign", st.parity_class(c("delta_percent")).alias("class"))


# The two halves of the suppliers are two sessions.
SESSIONS = """
sess AS (SELECT campaign % 2 AS session, campaign // 2 AS workload, implementation, median_fps FROM suites)"""


def sessions(t):
    suites = st.suite_statistics(runs(t), GROUP, "fps").select(
        (c("campaign") % 2).alias("session"), F.floor(c("campaign") / 2).cast("long").alias("workload"), "implementation", "median_fps")
    keys = ["workload", "implementation", "median_fps"]
    return suites.filter("session = 0").select(*keys), suites.filter("session = 1").select(*keys)


@query("J13_confirm_vs_final", WITH + f""", {SESSIONS}, d AS (SELECT a.workload, a.implementation, a.median_fps AS x, b.median_fps AS y, (b.median_fps / a.median_fps - 1.0) * 100.0 AS delta FROM sess a JOIN sess b ON a.session = 0 AND b.session = 1 AND a.workload = b.workload AND a.implementation = b.implementation)
SELECT workload, implementation, round(x, 8) AS confirmation_fps, round(y, 8) AS final_fps, round(delta, 6) AS delta_percent, round(max(abs(delta)) OVER (PARTITION BY workload), 6) AS max_absolute_delta_percent FROM d""")
def _j13(t):
    changes = st.confirm_vs_final(*sessions(t), ["workload", "implementation"], "median_fps")
    out = changes.join(st.largest_change(changes, ["workload"]), "workload")
    return out.select("workload", "implementation", F.round("confirmation_fps", 8).alias("confirmation_fps"), F.round("final_fps", 8).alias("final_fps"),
                      F.round("delta_percent", 6).alias("delta_percent"), F.round("max_absolute_delta_percent", 6).alias("max_absolute_delta_percent"))


@query("J20_session_scaling", WITH + f", {SESSIONS} SELECT a.workload, a.implementation, round(b.median_fps / a.median_fps, 8) AS scaling FROM sess a JOIN sess b ON a.session = 0 AND b.session = 1 AND a.workload = b.workload AND a.implementation = b.implementation")
def _j20(t):
    return rounded(st.session_scaling(*sessions(t), ["workload", "implementation"], "median_fps"), 8)


# A customer's orders are the frames of one run.
FRAMES = """
frames AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 7 AS extra FROM orders)"""


def frames(t):
    data = t.orders.select(
        c("o_custkey").alias("run"), micros("o_orderdate").alias("us"), "o_orderkey",
        F.round(c("o_totalprice") * 100).cast("long").alias("cents"), (c("o_orderkey") % 7).alias("extra"))
    year = by_width(c("us"), 365 * 86_400 * 1_000_000)
    return row_numbers(data, ["run"], ["us", "o_orderkey"], year, "position").withColumn("frame", c("position") - 1)


@query("A24_stage_profile", f"""WITH {FRAMES}, st AS (SELECT run, frame, 'decode' AS stage, cents AS ms FROM frames UNION ALL SELECT run, frame, 'infer', extra * 1000 + 1 FROM frames),
n AS (SELECT run, CASE WHEN max(frame) + 1 > 3 THEN 3 ELSE 0 END AS skip FROM frames GROUP BY 1), m AS (SELECT run, stage, count(*) AS frames, sum(ms) / count(*) AS stage_ms FROM st JOIN n USING (run) WHERE frame >= skip GROUP BY 1, 2)
SELECT run, stage, frames, round(stage_ms, 6) AS stage_ms, round(stage_ms / sum(stage_ms) OVER (PARTITION BY run) * 100, 6) AS share_percent FROM m""")
def _a24(t):
    stages = frames(t).select("run", "frame", F.inline(F.array(
        F.struct(F.lit("decode").alias("stage"), c("cents").alias("ms")),
        F.struct(F.lit("infer").alias("stage"), (c("extra") * 1000 + 1).alias("ms")),
    )))
    return rounded(st.stage_profile(stages, ["run"], "frame", "stage", "ms", 3))


@query("A25_frame_time_stats", f"""WITH {FRAMES}, g AS (SELECT run, count(*) AS n, sum(cents) / count(*) / 100 AS av, min(cents) / 100 AS mn, max(cents) / 100 AS mx, coalesce(sum(cents) FILTER (frame > 0) / count(*) FILTER (frame > 0) / 100, sum(cents) / count(*) / 100) AS aw FROM frames GROUP BY 1)
SELECT run, n AS frames, round(av, 6) AS average, round(mn, 6) AS shortest, round(mx, 6) AS longest, round(aw, 6) AS average_without_first, round(1 / av, 9) AS fps, round(1 / aw, 9) AS fps_without_first FROM g""")
def _a25(t):
    out = st.frame_time_stats(frames(t).withColumn("sec", c("cents") / 100), ["run"], "frame", "sec")
    return rounded(out.withColumns({"fps": F.round("fps", 9), "fps_without_first": F.round("fps_without_first", 9)}), 6,
                   "average", "shortest", "longest", "average_without_first")


@query("W13_moving_rate", f"""WITH {FRAMES}, m AS (SELECT run, frame + 1 AS position, sum(cents) OVER w / count(*) OVER w / 100 AS mean FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT run, position, round(mean, 6) AS mean_seconds, round(1 / mean, 9) AS fps FROM m WHERE position % 4 = 0 OR position = 1""")
def _w13(t):
    from fleetgauge.operators.sequence import moving_rate

    out = moving_rate(frames(t).withColumn("sec", c("cents") / 100), ["run"], "position", "sec", 4)
    return out.select("run", "position", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("fps", 9).alias("fps"))


@query("A42_matrix_check", f"""WITH v AS (SELECT o_custkey AS workload, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '720p' WHEN '2' THEN '1080p' WHEN '3' THEN '720p' WHEN '4' THEN '1080p' WHEN '5' THEN CASE WHEN o_custkey % 2 = 0 THEN '720p' ELSE '2160p' END END AS variant,
 o_orderstatus IN ('O', 'P', 'F') AND o_orderkey % 50 > 0 AS ok, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 40 > 0 ELSE true END AS contract FROM orders)
SELECT workload, {errors_sql(('required variants are missing', "count(DISTINCT variant) FILTER (variant IN ('720p', '1080p')) <> 2"), ('required variants occur more than once', "count(*) FILTER (variant IN ('720p', '1080p')) > count(DISTINCT variant) FILTER (variant IN ('720p', '1080p'))"),
 ('unexpected variants', "count(*) FILTER (variant = '2160p') > 0"),
 ('a campaign is not publishable', 'NOT bool_and(ok)'), ('shared contract changed', 'count(DISTINCT contract) > 1'))} AS errors FROM v GROUP BY workload""")
def _a42(t):
    level = F.substring("o_orderpriority", 1, 1)
    fifth = F.when(c("o_custkey") % 2 == 0, "720p").otherwise("2160p")
    data = t.orders.select(
        c("o_custkey").alias("workload"),
        F.when(level.isin("1", "3"), "720p").when(level.isin("2", "4"), "1080p").otherwise(fifth).alias("variant"),
        F.when(c("o_orderstatus").isin("O", "P", "F"), "valid").alias("status"), (c("o_orderkey") % 50 > 0).alias("publishable"),
        F.when(c("o_custkey") % 3 == 0, c("o_orderkey") % 40 > 0).otherwise(True).alias("gpu"), F.lit(2).alias("contract_version"),
    )
    return st.matrix_check(data, ["workload"], ["720p", "1080p"], ["gpu", "contract_version"]).select(
        "workload", F.array_join("errors", "; ").alias("errors"))


@query("A43_shared_contract", """WITH i AS (SELECT o_custkey AS session, o_orderpriority AS impl, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, count(DISTINCT o_orderstatus || (o_orderkey % 2)) > 1 AS ch FROM orders GROUP BY 1, 2)
SELECT session, min(lo) <> max(hi) AS session_changed, count(*) FILTER (ch) AS changed_implementations FROM i GROUP BY 1""")
def _a43(t):
    data = t.orders.select(
        c("o_custkey").alias("session"), c("o_orderpriority").alias("impl"), c("o_orderstatus").alias("sk"),
        F.concat("o_orderstatus", (c("o_orderkey") % 2).cast("string")).alias("ik"))
    return st.shared_contract(data, ["session"], "impl", "sk", "ik")


@query("S14_summary_sink_rows", WITH + """SELECT campaign, implementation, runs, format('{:.3f}', round(s.median_fps, 6)) AS median_fps, format('{:+.2f}%', round((s.median_fps / b.median_fps - 1) * 100, 6)) AS versus_baseline,
 format('{:.2f}', round(s.wall, 6)) AS wall_sec, format('{:.3f}', round(s.cores, 6)) AS cpu_cores, format('{:.1f}', round(s.vram, 6)) AS peak_vram_mib FROM suites s LEFT JOIN (SELECT campaign, median_fps FROM suites WHERE implementation = 'A') b USING (campaign)""")
def _s14(t):
    from fleetgauge.sources.reports import summary_sink_rows

    suites = st.implementation_statistics(runs(t), GROUP, "fps", {"median_wall_time_sec": "wall", "median_cpu_cores": "cores", "median_peak_vram_mib": "vram"})
    rel = st.relative_to_baseline(suites, ["campaign"], "implementation", "A", "median_fps")
    out = summary_sink_rows(rounded(rel))
    return out.select("campaign", "implementation", "runs", "median_fps", "versus_baseline", "wall_sec", "cpu_cores", "peak_vram_mib")
