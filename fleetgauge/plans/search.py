"""Search queries: a brand is one search, part sizes folded to 1..12 are its stream counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import search as sr
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query, rounded
from fleetgauge.sources.reports import resource_limit_series, sweep_series

c = F.col
KEYS = ["implementation"]
TOP = 12

# Odd brands peak at four streams, even ones keep rising.
POINTS = """
b AS (SELECT p_brand AS implementation, CAST(substr(p_brand, 7) AS BIGINT) AS no, 1 + p_size % 12 AS num_streams, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) AS base, min(p_type) AS kind, max(p_size) AS big FROM part GROUP BY 1, 2, 3),
points AS (SELECT *, base * CASE WHEN no % 2 = 1 THEN 20 - abs(num_streams - 4) ELSE 20 + num_streams END / 2000 AS fps, lower(replace(implementation, '#', '-')) || '-s' || num_streams || '-g0' AS candidate_id FROM b)"""
WITH = f"WITH {POINTS} "


def points(t):
    slot = c("num_streams")
    data = t.part.select(
        c("p_brand").alias("implementation"), F.substr("p_brand", F.lit(7)).cast("long").alias("no"), (1 + c("p_size") % 12).alias("num_streams"),
        F.round(c("p_retailprice") * 100).cast("long").alias("cents"), "p_type", "p_size",
    ).groupBy("implementation", "no", "num_streams").agg(
        (F.sum("cents") / F.count("*")).alias("base"), F.min("p_type").alias("kind"), F.max("p_size").alias("big"))
    shape = F.when(c("no") % 2 == 1, 20 - F.abs(slot - 4)).otherwise(20 + slot)
    return data.withColumns({
        "median_fps": c("base") * shape / 2000, "cuda_graph": F.lit(False),
        "candidate_id": F.concat(F.lower(F.replace("implementation", F.lit("#"), F.lit("-"))), F.lit("-s"), slot.cast("string"), F.lit("-g0")),
    })


@query("W07_confirmed_decline", WITH + """, w AS (SELECT implementation, num_streams, row_number() OVER o AS position, max(fps) OVER (o ROWS UNBOUNDED PRECEDING) AS best, max(fps) OVER (o ROWS 1 PRECEDING) AS recent FROM points WINDOW o AS (PARTITION BY implementation ORDER BY num_streams))
SELECT implementation, num_streams, position, position > 2 AND recent < best * (1 - 0.01) AS declined FROM w""", position="INTEGER")
def _w07(t):
    return sr.confirmed_decline(points(t), KEYS, 0.01, 2).select("implementation", "num_streams", "position", "declined")


@query("W08_sentinel_recovers", WITH + """, g AS (SELECT implementation, max(fps) FILTER (num_streams = 12) AS s, max(fps) FILTER (num_streams <> 12) AS b FROM points GROUP BY 1)
SELECT implementation, round(s, 6) AS sentinel_fps, round(b, 6) AS best_fps, coalesce(s > b * (1 + 0.01), false) AS recovers FROM g""")
def _w08(t):
    return rounded(sr.sentinel_recovers(points(t), KEYS, c("num_streams") == TOP, 0.01))


@query("W09_upper_boundary_open", WITH + """, m AS (SELECT implementation, max(num_streams) AS top FROM points GROUP BY 1)
SELECT implementation, count(*) AS points, count(*) < 2 OR coalesce(max(fps) FILTER (num_streams = top) > max(fps) FILTER (num_streams < top) * (1 + 0.01), true) AS open FROM points JOIN m USING (implementation) GROUP BY 1""")
def _w09(t):
    return sr.upper_boundary_open(points(t), KEYS, 0.01)


@query("W10_shortlist", WITH + """SELECT implementation, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY implementation ORDER BY fps DESC, num_streams, candidate_id) AS rank FROM points) WHERE rank <= 3""", rank="INTEGER")
def _w10(t):
    return sr.shortlist(points(t), KEYS, 3).select("implementation", "candidate_id", "rank")


@query("W11_peak_equivalent", WITH + """SELECT implementation, arg_min(candidate_id, (num_streams, candidate_id)) AS candidate_id, min(num_streams) AS num_streams FROM (SELECT *, max(fps) OVER (PARTITION BY implementation) AS peak FROM points) WHERE fps >= peak * (1 - 0.05) GROUP BY 1""")
def _w11(t):
    return sr.peak_equivalent(points(t), KEYS, 0.05).select("implementation", "candidate_id", "num_streams")


# What each search claims about its end; an early-stopped one has no points between stop and sentinel.
STATES = """
states AS (SELECT implementation, no, CASE no % 5 WHEN 0 THEN 'range-exhausted' WHEN 1 THEN 'decline-confirmed' WHEN 2 THEN 'sentinel-recovery-range-exhausted' WHEN 3 THEN 'resource-ceiling' ELSE 'stopped' END AS reason,
  CASE WHEN no % 5 IN (1, 2) OR no % 10 = 8 THEN 7 WHEN no % 20 = 0 THEN 3 END AS early, CASE WHEN no % 10 = 3 THEN 9 WHEN no % 10 = 8 THEN 12 WHEN no % 15 = 1 THEN 11 END AS lim FROM (SELECT DISTINCT implementation, no FROM points)),
pts AS (SELECT p.*, s.reason, s.early, s.lim FROM points p JOIN states s USING (implementation) WHERE NOT (s.no % 5 = 1 AND p.num_streams BETWEEN 8 AND 11) AND NOT (s.no % 10 = 3 AND p.num_streams >= 9) AND NOT (s.no % 10 = 8 AND p.num_streams > 7)),
dec AS (SELECT implementation, arg_max(position > 2 AND recent < best * (1 - 0.01), num_streams) AS declined FROM (SELECT *, row_number() OVER o AS position, max(fps) OVER (o ROWS UNBOUNDED PRECEDING) AS best, max(fps) OVER (o ROWS 1 PRECEDING) AS recent
  FROM pts WHERE early IS NULL OR num_streams <> 12 WINDOW o AS (PARTITION BY implementation ORDER BY num_streams)) GROUP BY 1),
sh AS (SELECT implementation, count(*) AS n, min(num_streams) AS lo, max(num_streams) AS hi, count(*) FILTER (num_streams <= early) AS bef, count(*) FILTER (num_streams = 12) AS sen,
  coalesce(max(fps) FILTER (num_streams = 12) > max(fps) FILTER (num_streams <> 12) * 1.01, false) AS rec FROM pts GROUP BY 1),
bd AS (SELECT implementation, n < 2 OR coalesce(max(fps) FILTER (num_streams = hi) > max(fps) FILTER (num_streams < hi) * 1.01, true) AS opn FROM pts JOIN sh USING (implementation) GROUP BY implementation, n),
z AS (SELECT *, reason IN ('range-exhausted', 'sentinel-recovery-range-exhausted') AS ex, reason = 'decline-confirmed' AS de, reason = 'resource-ceiling' AS ce, lo = 1 AND bef = early AS tostop FROM states JOIN sh USING (implementation) JOIN dec USING (implementation) JOIN bd USING (implementation))"""


def states(t):
    no = c("no")
    found = points(t).select("implementation", "no").distinct()
    return found.select(
        "implementation", "no",
        F.when(no % 5 == 0, "range-exhausted").when(no % 5 == 1, "decline-confirmed").when(no % 5 == 2, "sentinel-recovery-range-exhausted")
        .when(no % 5 == 3, "resource-ceiling").otherwise("stopped").alias("completion_reason"),
        F.when((no % 5).isin(1, 2) | (no % 10 == 8), 7).when(no % 20 == 0, 3).alias("early_stop"),
        F.when(no % 10 == 3, 9).when(no % 10 == 8, 12).when(no % 15 == 1, 11).alias("limit_streams"),
    )


def finished(t):
    no, slot = c("no"), c("num_streams")
    return points(t).filter(
        ~((no % 5 == 1) & slot.between(8, 11)) & ~((no % 10 == 3) & (slot >= 9)) & ~((no % 10 == 8) & (slot > 7)))


@query("W12_search_completion", WITH + f""", {STATES} SELECT implementation, reason AS completion_reason, {errors_sql(
 ('invalid completion reason', "reason = 'stopped'"), ('unexpected resource limit', '(ex OR de) AND lim IS NOT NULL'), ('did not exhaust the range', 'ex AND NOT (n = 12 AND lo = 1 AND hi = 12)'),
 ('unexpected early stop', "reason = 'range-exhausted' AND early IS NOT NULL"), ('ended at an increasing upper boundary', 'ex AND opn'),
 ('changed the decline-confirmed range', 'de AND NOT (tostop AND n = bef + 1 AND sen = 1)'), ('stopped without a confirmed decline', 'de AND NOT declined'), ('ignored a recovering sentinel', 'de AND rec'),
 ('resource ceiling is not above valid points', 'ce AND NOT lim > hi'), ('skipped points before its resource ceiling', 'ce AND early IS NULL AND NOT (n = lim - 1 AND lo = 1 AND hi = lim - 1)'),
 ('invalid sentinel stop', 'ce AND early IS NOT NULL AND lim <> 12'), ('unproven decline before the sentinel', 'ce AND early IS NOT NULL AND NOT (tostop AND n = bef AND declined)'))} AS errors FROM z""")
def _w12(t):
    return sr.search_completion(finished(t), states(t), KEYS, 1, TOP, 0.01, 2).select("implementation", "completion_reason", joined())


CONFIRM = """
short AS (SELECT implementation, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY implementation ORDER BY fps DESC, num_streams, candidate_id) AS rank FROM points) WHERE rank <= 3),
conf AS (SELECT implementation, candidate_id, num_streams, fps FROM points WHERE no % 3 > 0 OR num_streams > 9),
win AS (SELECT implementation, arg_min(candidate_id, (num_streams, candidate_id)) AS provisional FROM (SELECT conf.*, max(fps) OVER (PARTITION BY implementation) AS peak FROM conf JOIN short USING (implementation, candidate_id)) WHERE fps >= peak * (1 - 0.05) GROUP BY 1),
want AS (SELECT implementation, candidate_id FROM short UNION SELECT implementation, regexp_replace(provisional, '-g0$', '-g1') FROM win JOIN (SELECT DISTINCT implementation, no FROM points) USING (implementation) WHERE no % 2 = 0),
diff AS (SELECT coalesce(w.implementation, c.implementation) AS implementation, count(*) FILTER (c.candidate_id IS NULL) AS missing, count(*) FILTER (w.candidate_id IS NULL) AS unexpected FROM want w FULL JOIN conf c ON w.implementation = c.implementation AND w.candidate_id = c.candidate_id GROUP BY 1)"""


@query("W12b_confirmation_errors", WITH + f", {CONFIRM} SELECT implementation, missing, unexpected, provisional, {errors_sql(('incomplete confirmation evidence', 'missing > 0'), ('unexpected confirmation candidates', 'unexpected > 0'), ('no provisional winner', 'provisional IS NULL'))} AS errors FROM diff LEFT JOIN win USING (implementation)")
def _w12b(t):
    data = points(t)
    confirmed = data.filter((c("no") % 3 > 0) | (c("num_streams") > 9))
    probes = data.select("implementation", (c("no") % 2 == 0).alias("probe_graph")).distinct()
    return sr.confirmation_errors(data, confirmed, KEYS, 3, 0.05, probes).select("implementation", "missing", "unexpected", "provisional", joined())


REJECTED = "rej AS (SELECT lower(replace(p_brand, '#', '-')) || '-s' || (1 + p_size % 12) || '-g0' AS candidate_id, arg_max(p_name, p_partkey) AS reason FROM part WHERE p_type = 'ECONOMY' AND p_size > 30 GROUP BY 1)"


def rejections(t):
    return t.part.filter("p_type = 'ECONOMY' AND p_size > 30").select(
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-s"), (1 + c("p_size") % 12).cast("string"), F.lit("-g0")).alias("candidate_id"),
        c("p_name").alias("reason"), "p_partkey")


@query("J14_apply_disqualifications", WITH + f", {REJECTED} SELECT candidate_id, rej.reason AS reject_reason, big > 35 AND rej.reason IS NULL AS eligible FROM points LEFT JOIN rej USING (candidate_id)")
def _j14(t):
    data = points(t).withColumn("eligible", c("big") > 35)
    return sr.apply_disqualifications(data, rejections(t), "candidate_id", "p_partkey").select("candidate_id", "reject_reason", "eligible")


@query("W16_rank_candidates", WITH + f""", {REJECTED}, cd AS (SELECT p.*, big > 35 AND rej.reason IS NULL AS eligible, p.no % 7 > 0 OR num_streams > 2 AS complete FROM points p LEFT JOIN rej USING (candidate_id)),
w AS (SELECT implementation, arg_min(candidate_id, (num_streams, candidate_id)) AS winner, arg_min(fps, (num_streams, candidate_id)) AS winner_fps FROM (SELECT *, max(fps) OVER (PARTITION BY implementation) AS peak FROM cd WHERE eligible AND complete) WHERE fps >= peak * (1 - 0.05) GROUP BY 1),
s AS (SELECT implementation, count(*) AS candidates, count(*) FILTER (NOT complete) AS incomplete FROM cd GROUP BY 1)
SELECT implementation, candidates, incomplete, winner, round(winner_fps, 6) AS winner_fps, {errors_sql(('complete confirmation evidence is missing', 'incomplete > 0'), ('no eligible candidate remains', 'winner IS NULL'))} AS errors FROM s LEFT JOIN w USING (implementation)""")
def _w16(t):
    data = points(t).withColumns({"eligible": c("big") > 35, "evidence_complete": (c("no") % 7 > 0) | (c("num_streams") > 2)})
    judged = sr.apply_disqualifications(data, rejections(t), "candidate_id", "p_partkey")
    out = sr.rank_candidates(judged, KEYS, 0.05)
    return rounded(out.select("implementation", "candidates", "incomplete", "winner", "winner_fps", joined()))


@query("J22_disqualification_evidence", """SELECT c_custkey, coalesce(n = 1, false) AS proven FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def _j22(t):
    invalid = (c("o_orderstatus") == "P") & (c("o_orderpriority") == "1-URGENT")
    reports = t.orders.select(c("o_custkey").alias("c_custkey"), F.when(invalid, "invalid").otherwise("valid").alias("status"))
    return sr.disqualification_evidence(t.customer.select("c_custkey"), reports, ["c_custkey"]).select("c_custkey", "proven")


@query("J23_common_failure", """SELECT l_orderkey, count(*) = 2 AND count(DISTINCT l_returnflag) = 2 AND bool_and(l_linestatus <> 'O') AND min(l_linenumber % 2) = max(l_linenumber % 2) AS common_failure FROM lineitem GROUP BY 1""")
def _j23(t):
    rows = t.lineitem.select(
        "l_orderkey", c("l_returnflag").alias("implementation"), F.when(c("l_linestatus") == "O", "valid").otherwise("invalid").alias("status"),
        F.sha2((c("l_linenumber") % 2).cast("string"), 256).alias("output_sha256"))
    return sr.common_failure(rows, ["l_orderkey"], 2).select("l_orderkey", "common_failure")


@query("S15_sweep_series", WITH + """, w AS (SELECT implementation, arg_min(candidate_id, (num_streams, candidate_id)) AS candidate_id FROM (SELECT *, max(fps) OVER (PARTITION BY implementation) AS peak FROM points) WHERE fps >= peak * (1 - 0.05) GROUP BY 1)
SELECT p.implementation, p.candidate_id, num_streams AS streams, round(fps, 6) AS fps, w.candidate_id IS NOT NULL AS winner FROM points p LEFT JOIN w ON w.implementation = p.implementation AND w.candidate_id = p.candidate_id WHERE big > 35 AND p.no % 4 > 0 ORDER BY 1, 3""")
def _s15(t):
    data = points(t)
    marked = data.withColumns({"status": F.when(c("big") > 35, "eligible").otherwise("disqualified"), "threads": F.when(c("no") % 4 > 0, "auto").otherwise("4")})
    return rounded(sweep_series(marked, sr.peak_equivalent(data, KEYS, 0.05)))


@query("S16_resource_limit_series", """SELECT o_orderkey, 'left' AS implementation, o_orderkey % 10 AS streams, 'cuda-oom' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'right', o_custkey % 10, 'cuda-oom' FROM orders WHERE o_orderpriority = '5-LOW'""")
def _s16(t):
    limit = lambda cond, n: F.when(cond, F.struct(n.alias("num_streams"), F.lit("cuda-oom").alias("kind")))
    limits = F.create_map(
        F.lit("left"), limit(c("o_orderstatus") == "F", c("o_orderkey") % 10),
        F.lit("right"), limit(c("o_orderpriority") == "5-LOW", c("o_custkey") % 10))
    return resource_limit_series(t.orders.select("o_orderkey", limits.alias("resource_limits")), ["o_orderkey"])
