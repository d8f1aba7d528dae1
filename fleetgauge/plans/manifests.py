"""Run manifests in their nested form, derived from whole orders; flat SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

c = F.col

MANIFEST_SQL = """
m AS (SELECT o_orderkey AS k, o_custkey AS cu,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'valid' ELSE 'failed' END AS status, o_orderpriority AS product,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'w' || (o_custkey % 4) END AS workload_id,
  CASE o_custkey % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' END AS variant,
  CAST(o_orderkey % 6 AS BIGINT) AS benchmark_contract_version, CAST(o_orderkey % 3 + 1 AS BIGINT) AS run_index,
  CAST(o_orderkey % 7 * 100 AS BIGINT) AS frames, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 4 AS BIGINT) END AS warmup_frames,
  CASE WHEN o_orderkey % 23 > 0 THEN '{"codec":"h264","gop":' || (o_custkey % 2) || '}' END AS encoder,
  CASE WHEN o_orderkey % 13 > 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'tuned' ELSE 'upstream-default' END END AS execution_profile,
  'auto' AS vspipe_requests, CASE WHEN o_orderkey % 17 > 0 THEN CAST(o_custkey % 8 + 1 AS BIGINT) END AS num_streams,
  'auto' AS vapoursynth_threads, o_orderkey % 2 = 0 AS cuda_graph,
  sha256(CAST(o_custkey % 100 AS VARCHAR)) AS input_sha256,
  CASE WHEN o_orderkey % 29 = 0 THEN 'abc' ELSE sha256('m' || (o_custkey % 5)) END AS onnx_sha256,
  sha256(o_orderpriority) AS engine_sha256, CASE WHEN o_orderkey % 37 > 0 THEN sha256('w' || (o_custkey % 4)) END AS workload_sha256,
  CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' WHEN o_orderkey % 31 = 1 THEN '' ELSE 'image-' || (o_custkey % 3) END AS image_id,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'rev' || (o_custkey % 2) END AS repository_revision,
  CASE o_orderkey % 10 WHEN 0 THEN '1' WHEN 1 THEN 'False' ELSE '0' END AS source_dirty,
  CASE WHEN o_orderkey % 43 > 0 THEN '{"cpu":{"name":"c' || (o_custkey % 2) || '"},"gpu":{"name":"g' || (o_custkey % 3) || '"}}' END AS environment,
  o_orderkey % 8 > 0 AS publishable, o_orderkey % 9 > 0 AS media_valid
 FROM orders)"""


def manifests(t):
    """One nested manifest per order, with gaps and defects at fixed places."""
    k, cu = c("o_orderkey"), c("o_custkey")
    text = lambda v: v.cast("string")
    mod = lambda n: k % n
    asset = lambda v: F.struct(v.alias("sha256"))
    gpu_cpu = mod(43) > 0
    parameters = F.struct(
        (mod(7) * 100).cast("long").alias("frames"),
        F.when(mod(5) > 0, mod(4).cast("long")).alias("warmup_frames"),
        F.when(mod(23) > 0, F.struct(F.lit("h264").alias("codec"), (cu % 2).alias("gop"))).alias("encoder"),
        F.when(mod(13) > 0, F.when(cu % 2 == 0, "tuned").otherwise("upstream-default")).alias("execution_profile"),
        F.lit("auto").alias("vspipe_requests"),
        F.when(mod(17) > 0, (cu % 8 + 1).cast("long")).alias("num_streams"),
        F.lit("auto").alias("vapoursynth_threads"),
        (mod(2) == 0).alias("cuda_graph"),
    )
    environment = F.struct(
        F.struct(
            F.when(mod(31) == 0, "unknown").when(mod(31) == 1, "").otherwise(F.concat(F.lit("image-"), text(cu % 3))).alias("id"),
            F.when(mod(41) != 0, F.concat(F.lit("rev"), text(cu % 2))).alias("repository_revision"),
            F.when(mod(10) == 0, "1").when(mod(10) == 1, "False").otherwise("0").alias("source_dirty"),
        ).alias("image"),
        F.when(gpu_cpu, F.struct(F.concat(F.lit("g"), text(cu % 3)).alias("name"))).alias("gpu"),
        F.when(gpu_cpu, F.struct(F.concat(F.lit("c"), text(cu % 2)).alias("name"))).alias("cpu"),
    )
    assets = F.struct(
        asset(F.sha2(text(cu % 100), 256)).alias("input"),
        asset(F.when(mod(29) == 0, "abc").otherwise(F.sha2(F.concat(F.lit("m"), text(cu % 5)), 256))).alias("onnx"),
        asset(F.sha2("o_orderpriority", 256)).alias("engine"),
        asset(F.when(mod(37) > 0, F.sha2(F.concat(F.lit("w"), text(cu % 4)), 256))).alias("workload_manifest"),
    )
    return t.orders.select(
        k.alias("k"),
        F.when(c("o_orderstatus").isin("F", "O"), "valid").otherwise("failed").alias("status"),
        c("o_orderpriority").alias("product"),
        F.when(mod(19) == 0, "").otherwise(F.concat(F.lit("w"), text(cu % 4))).alias("workload_id"),
        F.when(cu % 3 == 0, "720p").when(cu % 3 == 1, "1080p").alias("variant"),
        mod(6).cast("long").alias("benchmark_contract_version"),
        (mod(3) + 1).cast("long").alias("run_index"),
        parameters.alias("parameters"), assets.alias("assets"), environment.alias("environment"),
        F.struct((mod(8) > 0).alias("publishable")).alias("reproducibility"),
        F.struct(F.struct((mod(9) > 0).alias("valid")).alias("validation")).alias("measured"),
    )


def errors_sql(*rules: tuple[str, str]) -> str:
    """``concat_ws`` over (label, SQL condition) pairs."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in rules) + ")"


def joined(column: str = "errors"):
    return F.array_join(column, "; ").alias(column)
