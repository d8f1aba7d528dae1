"""Evidence rollups, published results and user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import evidence as ev
from fleetgauge.operators import joins as jn
from fleetgauge.operators import stats as st
from fleetgauge.operators.hooks import apply_checks, metric_statistics
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query, rounded
from fleetgauge.plans.stats import GROUP, WITH, runs

c = F.col


@query("A31_product_rollup", """SELECT p_partkey, p_partkey % 9 = 0 AS exact, CASE WHEN p_partkey % 9 > 0 THEN 30.0 + p_size END AS average_db, 1000 - p_size % 2 AS psnr_frames,
 CASE WHEN p_partkey % 5 > 0 THEN 1 - p_size / 1000.0 END AS ssim, CASE WHEN p_partkey % 5 > 0 THEN 1000 END AS ssim_frames FROM part""", average_db="DOUBLE")
def _a31(t):
    psnr = t.part.select("p_partkey", (c("p_partkey") % 9 == 0).alias("exact"), F.when(c("p_partkey") % 9 > 0, 30.0 + c("p_size")).alias("average_db"), (1000 - c("p_size") % 2).alias("frames"))
    ssim = t.part.filter("p_partkey % 5 > 0").select("p_partkey", (1 - c("p_size") / 1000.0).alias("all"), F.lit(1000).alias("frames"))
    return rounded(ev.product_rollup(psnr, ssim, ["p_partkey"]))


OBSERVED = """
ob AS (SELECT l_suppkey AS suite, l_quantity AS peak_c, l_linenumber = 3 AND l_discount > 0.09 AS cap, CASE WHEN l_tax > 0.07 THEN ['sw_power_cap', 'gpu_idle'] WHEN l_returnflag = 'R' THEN ['sync_boost'] ELSE [] END AS reasons FROM lineitem),
rs AS (SELECT suite, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons FROM (SELECT suite, unnest(reasons) AS r FROM ob) GROUP BY 1),
seen AS (SELECT suite, max(peak_c) AS peak_temperature_c, bool_or(cap) AS power_cap_observed, coalesce(any_value(rs.reasons), '') AS throttle_reasons FROM ob LEFT JOIN rs USING (suite) GROUP BY 1)"""


def observed(t):
    none = F.array().cast("array<string>")
    reasons = F.when(c("l_tax") > 0.07, F.array(F.lit("sw_power_cap"), F.lit("gpu_idle"))).when(c("l_returnflag") == "R", F.array(F.lit("sync_boost"))).otherwise(none)
    return t.lineitem.select(
        c("l_suppkey").alias("suite"), c("l_quantity").alias("peak_c"), ((c("l_linenumber") == 3) & (c("l_discount") > 0.09)).alias("power_cap_observed"), reasons.alias("throttle_reasons"),
        F.when((c("l_suppkey") % 11 == 0) & (c("l_quantity") == 50), "failed").otherwise("valid").alias("status"), F.when((c("l_suppkey") % 13 == 0) & (c("l_tax") == 0), "1").otherwise("0").alias("source_dirty"),
        F.when(c("l_suppkey") % 7 == 0, c("l_returnflag")).otherwise("same").alias("environment"), F.lit("a").alias("assets"), F.lit(1000).alias("parameters"))


@query("A32_session_observations", f"WITH {OBSERVED} SELECT * FROM seen")
def _a32(t):
    return ev.session_observations(observed(t), ["suite"]).withColumn("throttle_reasons", F.array_join("throttle_reasons", ","))


@query("A34_provenance_flags", """WITH w AS (SELECT o_custkey % 10 AS session, o_custkey AS workload, count(DISTINCT o_orderstatus) = 3 AS e, count(DISTINCT CASE WHEN o_custkey % 10 = 3 THEN o_orderkey % 3 ELSE o_orderkey % 2 END) = 3 AS i FROM orders GROUP BY 1, 2)
SELECT session, bool_and(e) AS engine_differ, bool_and(i) AS image_differ FROM w GROUP BY 1""")
def _a34(t):
    image = F.when(c("o_custkey") % 10 == 3, c("o_orderkey") % 3).otherwise(c("o_orderkey") % 2)
    rows = t.orders.select((c("o_custkey") % 10).alias("session"), c("o_custkey").alias("workload"), c("o_orderstatus").alias("engine"), image.alias("image"))
    return ev.provenance_flags(rows, ["session"], ["workload"], ["engine", "image"], 3)


@query("A51_output_parity", f"""
WITH m AS (SELECT p_brand AS report, p_partkey, p_partkey % 9 = 0 AS exact, CASE WHEN p_partkey % 9 > 0 THEN 30.0 + p_size END AS psnr, CASE WHEN p_size % 10 = 0 THEN 999 ELSE 1000 END AS pf, CASE WHEN p_partkey % 5 > 0 THEN 1 - p_size / 1000.0 END AS ssim, CASE WHEN p_partkey % 5 > 0 THEN 1000 END AS sf FROM part)
SELECT report, p_partkey, exact, psnr AS psnr_db, round(ssim, 6) AS ssim, {errors_sql(('candidates are not exactly the expected products', 'true'), ('compared frames differ from expected frames', 'pf <> 1000 OR sf IS NULL'),
 ('psnr must be >= 40', 'NOT exact AND psnr < 40'), ('ssim must be >= 0.97', 'ssim IS NULL OR ssim < 0.97'))} AS errors, 'invalid' AS status FROM m WHERE right(report, 1) = '1'
UNION ALL SELECT report, p_partkey, exact, psnr, round(ssim, 6), {errors_sql(('compared frames differ from expected frames', 'pf <> 1000 OR sf IS NULL'), ('psnr must be >= 40', 'NOT exact AND psnr < 40'), ('ssim must be >= 0.97', 'ssim IS NULL OR ssim < 0.97'))},
 CASE WHEN pf <> 1000 OR sf IS NULL OR (NOT exact AND psnr < 40) OR ssim < 0.97 THEN 'invalid' ELSE 'valid' END FROM m WHERE right(report, 1) <> '1'""", psnr_db="DOUBLE")
def _a51(t):
    same = [F.lit("x").alias(n) for n in ("workload_id", "variant", "encoder", "input_sha256", "onnx_sha256", "engine_sha256")]
    brands = t.part.select(c("p_brand").alias("report")).distinct()
    refs = brands.select("report", *same, F.lit(1000).alias("frames"))
    products = F.when(c("report").endswith("1"), F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    cands = brands.select("report", F.explode(products).alias("product"), *same, F.lit(1000).alias("frames"))
    evidence = jn.evidence_set_errors(refs, cands, "report", ["one", "two"], 1000)
    key = [c("p_brand").alias("report"), "p_partkey"]
    psnr = t.part.select(*key, (c("p_partkey") % 9 == 0).alias("exact"), F.when(c("p_partkey") % 9 > 0, 30.0 + c("p_size")).alias("average_db"), F.when(c("p_size") % 10 == 0, 999).otherwise(1000).alias("frames"))
    ssim = t.part.filter("p_partkey % 5 > 0").select(*key, (1 - c("p_size") / 1000.0).alias("all"), F.lit(1000).alias("frames"))
    out = ev.output_parity(evidence, psnr, ssim, ["report", "p_partkey"], "report", F.lit(1000), {"psnr_min_db": 40.0, "ssim_min": 0.97})
    return rounded(out.select("report", "p_partkey", "exact", "psnr_db", "ssim", joined(), "status"))


@query("A52_published_results", WITH + f""", cam AS (SELECT 'w' || (campaign // 2) AS workload_id, CASE WHEN campaign % 2 = 0 THEN '720p' ELSE '1080p' END AS variant, implementation, median_fps, CASE WHEN relative_spread > 0.3 THEN 'unstable' ELSE 'valid' END AS status, max_fps FROM suites),
req AS (SELECT 'w' || s_suppkey AS workload_id, v.variant FROM supplier, (VALUES ('720p'), ('1080p')) v(variant) WHERE s_suppkey % 3 > 0),
r AS (SELECT q.*, q.implementation IS NOT NULL AS have, req.workload_id IS NOT NULL AS wanted, coalesce(q.workload_id, req.workload_id) AS wid, coalesce(q.variant, req.variant) AS var FROM cam q FULL JOIN req ON req.workload_id = q.workload_id AND req.variant = q.variant),
z AS (SELECT *, CASE WHEN CAST(substr(wid, 2) AS BIGINT) % 7 > 0 AND have THEN CAST(substr(wid, 2) AS BIGINT) % 2 = 0 END AS oid FROM r)
SELECT wid AS workload_id, var AS variant, implementation, round(median_fps, 8) AS median_fps, round(CASE WHEN implementation <> 'A' THEN max_fps END, 8) AS confirmation_fps, round(CASE WHEN implementation <> 'A' THEN (median_fps / max_fps - 1.0) * 100.0 END, 6) AS delta_percent,
 oid AS outputs_identical, {errors_sql(('required workload is missing', 'NOT have'), ('workload is not part of the matrix', 'have AND NOT wanted'), ('campaign is not valid', "have AND status <> 'valid'"), ('no output identity', 'have AND oid IS NULL'))} AS errors FROM z""")
def _a52(t):
    suites = st.suite_statistics(runs(t), GROUP, "fps")
    keyed = suites.select(
        F.concat(F.lit("w"), F.floor(c("campaign") / 2).cast("string")).alias("workload_id"), F.when(c("campaign") % 2 == 0, "720p").otherwise("1080p").alias("variant"),
        "implementation", "median_fps", F.when(c("relative_spread") > 0.3, "unstable").otherwise("valid").alias("status"), "max_fps")
    keys = ["workload_id", "variant"]
    winners = keyed.filter("implementation <> 'A'").select(*keys, "implementation", c("max_fps").alias("confirmation_fps"))
    quality = keyed.select(*keys, "implementation", F.lit(0.1).alias("max_rmse"), F.lit(50.0).alias("min_psnr_db"))
    number = F.substr("workload_id", F.lit(2)).cast("long")
    identity = keyed.select(*keys).distinct().filter(number % 7 > 0).select(*keys, F.lit(True).alias("tensors_identical"), (number % 2 == 0).alias("outputs_identical"))
    required = t.supplier.filter("s_suppkey % 3 > 0").select(
        F.concat(F.lit("w"), c("s_suppkey").cast("string")).alias("workload_id"), F.explode(F.array(F.lit("720p"), F.lit("1080p"))).alias("variant"))
    out = ev.published_results(keyed.drop("max_fps"), winners, quality, identity, required)
    return out.select(*keys, "implementation", F.round("median_fps", 8).alias("median_fps"), F.round("confirmation_fps", 8).alias("confirmation_fps"),
                      F.round("delta_percent", 6).alias("delta_percent"), "outputs_identical", joined())


@query("A53_published_diagnostics", f"""WITH {OBSERVED}, f AS (SELECT l_suppkey AS suite, count(*) AS runs, bool_or(l_suppkey % 11 = 0 AND l_quantity = 50) AS failed, bool_or(l_suppkey % 13 = 0 AND l_tax = 0) AS dirty, l_suppkey % 7 = 0 AND count(DISTINCT l_returnflag) > 1 AS env FROM lineitem GROUP BY 1)
SELECT s_suppkey AS suite, runs, peak_temperature_c, power_cap_observed, throttle_reasons, {errors_sql(('invalid suite', 's_nationkey % 5 = 0'), ('unpublishable suite', 's_nationkey % 4 = 0'), ('suite has no runs', 'runs IS NULL'), ('invalid run', 'failed'), ('dirty run source', 'dirty'), ('run environment drift', 'env'))} AS errors
FROM supplier LEFT JOIN f ON f.suite = s_suppkey LEFT JOIN seen ON seen.suite = s_suppkey""")
def _a53(t):
    suites = t.supplier.select(
        c("s_suppkey").alias("suite"), F.when(c("s_nationkey") % 5 == 0, "unstable").otherwise("valid").alias("status"), (c("s_nationkey") % 4 > 0).alias("publishable"))
    out = ev.published_diagnostics(suites, observed(t), "suite", ["parameters", "environment", "assets"])
    return out.select("suite", "runs", "peak_temperature_c", "power_cap_observed", F.array_join("throttle_reasons", ",").alias("throttle_reasons"), joined())


@query("Y01_metric_expr", WITH + ", w AS (SELECT campaign, implementation, wall / fps AS m FROM runs) SELECT campaign, implementation, count(*) AS runs, round(median(m), 6) AS median_fps, round(min(m), 6) AS min_fps, round(max(m), 6) AS max_fps, round((max(m) - min(m)) / median(m), 8) AS relative_spread FROM w GROUP BY 1, 2")
def _y01(t):
    out = metric_statistics(runs(t), GROUP, lambda df: df["wall"] / df["fps"])
    return rounded(out.withColumn("relative_spread", F.round("relative_spread", 8)), 6, "median_fps", "min_fps", "max_fps")


@query("Y02_check_hook", f"SELECT o_orderkey, {errors_sql(('price is low', 'o_totalprice < 50000'), ('not urgent', "o_orderpriority <> '1-URGENT'"))} AS errors FROM orders")
def _y02(t):
    checks = [("price is low", lambda df: df["o_totalprice"] < 50000), ("not urgent", lambda df: df["o_orderpriority"] != "1-URGENT")]
    return apply_checks(t.orders, checks).select("o_orderkey", joined())
