"""Contract-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.functions import scalars as sc
from fleetgauge.operators import checks as ck
from fleetgauge.plans.manifests import MANIFEST_SQL, errors_sql, joined, manifests
from fleetgauge.plans.registry import query

c = F.col


@query("P01_strict_metric", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) WHEN 1 THEN value END AS metric FROM events""")
def _p01(t):
    k = F.get_json_object("props", "$.k")
    slot = c("event_id") % 6
    leaf = (
        F.when(slot == 0, k).when(slot == 1, c("value").cast("string")).when(slot == 2, "true")
        .when(slot == 3, F.concat(F.lit('"'), k, F.lit('"'))).when(slot == 4, "null")
    )
    document = F.when(leaf.isNull(), '{"metrics":{}}').otherwise(F.concat(F.lit('{"metrics":{"fps":'), leaf, F.lit("}}")))
    return t.events.select("event_id", R.strict_metric(document, "$.metrics.fps").alias("metric"))


@query("P02_finite_bounds", """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN -o_totalprice WHEN 4 THEN o_totalprice END AS x FROM orders)
SELECT o_orderkey, coalesce(isfinite(x) AND x > 0, false) AS positive, coalesce(isfinite(x) AND x >= 0, false) AS not_negative FROM v""")
def _p02(t):
    slot, price = c("o_orderkey") % 6, c("o_totalprice")
    x = (
        F.when(slot == 0, F.lit(float("nan"))).when(slot == 1, F.lit(float("inf"))).when(slot == 2, 0.0)
        .when(slot == 3, -price).when(slot == 4, price)
    )
    return t.orders.select(
        "o_orderkey", R.finite_bounds(x).alias("positive"), R.finite_bounds(x, strict=False).alias("not_negative")
    )


@query("P03_drift_labels", f"""SELECT o_orderkey, {errors_sql(
    ('status', "o_orderstatus IS DISTINCT FROM 'O'"), ('priority', "o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    ('segment', "c_mktsegment IS DISTINCT FROM CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' END"))} AS errors
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _p03(t):
    df = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left")
    found = R.drift([
        ("status", c("o_orderstatus"), F.lit("O")), ("priority", c("o_orderpriority"), F.lit("1-URGENT")),
        ("segment", c("c_mktsegment"), F.when(c("o_orderkey") % 2 == 0, "BUILDING")),
    ])
    return df.select("o_orderkey", F.array_join(found, "; ").alias("errors"))


IDENTITY = "workload_id, variant, benchmark_contract_version, input_sha256, onnx_sha256, engine_sha256, workload_sha256, image_id, repository_revision, environment, frames, warmup_frames, encoder"
IDENTITY_ERRORS = errors_sql(
    ("no GPU contract", "environment IS NULL"), ("no CPU contract", "environment IS NULL"),
    ("no encoder contract", "encoder IS NULL"), ("no workload id", "workload_id = ''"), ("no variant", "variant IS NULL"),
    ("no image id", "image_id = ''"), ("no repository revision", "repository_revision IS NULL"),
    ("built from dirty source", "source_dirty <> '0'"), ("invalid measured frame count", "frames <= 0"),
    ("invalid warm-up frame count", "coalesce(warmup_frames, 0) <= 0"),
    ("no valid workload_manifest checksum", "workload_sha256 IS NULL"), ("no valid contract version", "benchmark_contract_version <= 0"),
    ("no valid onnx checksum", "length(onnx_sha256) <> 64"),
)


@query("P04_extract_identity", f"WITH {MANIFEST_SQL} SELECT k, {IDENTITY}, {IDENTITY_ERRORS} AS errors FROM m")
def _p04(t):
    found = ck.extract_identity(manifests(t), checksum_length=64, require_hardware=True, keep=("k",))
    return found.withColumn("errors", joined())


def key_sql(fields):
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '∅')" for f in fields) + "))"


@query("P05_identity_keys", f"""WITH {MANIFEST_SQL} SELECT k, {key_sql(ck.SHARED_MODEL_KEY)} AS shared_model_key,
 {key_sql(ck.SHARED_MODEL_KEY + ck.PER_IMPLEMENTATION)} AS implementation_key, {key_sql(ck.SESSION_KEY)} AS session_key,
 {key_sql(ck.SESSION_KEY + ck.PER_IMPLEMENTATION)} AS session_implementation_key FROM m""")
def _p05(t):
    keyed = ck.identity_keys(ck.extract_identity(manifests(t), keep=("k",)))
    return keyed.select("k", "shared_model_key", "implementation_key", "session_key", "session_implementation_key")


RUN_ERRORS = errors_sql(
    ("status is not valid", "status <> 'valid'"), ("changed product", "product <> '2-HIGH'"), ("changed workload", "workload_id <> 'w1'"),
    ("changed run index", "run_index <> 1"), ("not reproducible", "NOT publishable"), ("failed media validation", "NOT media_valid"),
    ("changed execution profile", "execution_profile IS DISTINCT FROM 'tuned' OR num_streams IS DISTINCT FROM 3 OR cuda_graph IS DISTINCT FROM false"),
)


@query("P06_validate_runs", f"WITH {MANIFEST_SQL} SELECT k, {RUN_ERRORS} AS errors FROM m")
def _p06(t):
    expectation = {"product": "2-HIGH", "workload_id": "w1", "variant": None, "run_index": 1}
    profile = {"execution_profile": "tuned", "num_streams": 3, "cuda_graph": False}
    return ck.validate_runs(manifests(t), expectation, profile, require_media=True).select("k", joined())


@query("P07_profile_fields", f"""WITH {MANIFEST_SQL} SELECT k, execution_profile, vspipe_requests, num_streams, vapoursynth_threads, cuda_graph,
 {errors_sql(('execution_profile', 'execution_profile IS NULL'), ('num_streams', 'num_streams IS NULL'))} AS missing FROM m""")
def _p07(t):
    return ck.profile_fields(manifests(t)).select("k", *ck.PROFILE_FIELDS, joined("missing"))


@query("P08_environment_errors", f"""WITH {MANIFEST_SQL} SELECT k, {errors_sql(
    ('image id is unknown', "image_id IN ('', 'unknown')"), ('repository revision is unknown', 'repository_revision IS NULL'),
    ('image was built from unknown or dirty source', "lower(source_dirty) NOT IN ('0', 'false')"))} AS errors FROM m""")
def _p08(t):
    image = "environment.image"
    found = ck.environment_errors(c(f"{image}.id"), c(f"{image}.repository_revision"), c(f"{image}.source_dirty"))
    return manifests(t).select("k", F.array_join(found, "; ").alias("errors"))


@query("P09_tensor_gate", f"""
WITH v AS (SELECT o_orderkey, o_orderkey % 11 > 0 AS fin, o_orderkey % 7 = 0 AS exact, (o_orderkey % 100) / 1000.0 AS p99,
  (o_custkey % 50) / 1000.0 AS rmse, CASE WHEN o_orderkey % 7 > 0 THEN 30.0 + o_custkey % 40 END AS psnr FROM orders)
SELECT o_orderkey, {errors_sql(('tensor contains NaN or infinity', 'NOT fin'), ('p99_abs must be <= 0.05', 'fin AND p99 > 0.05'),
 ('rmse must be <= 0.02', 'fin AND rmse > 0.02'), ('psnr_db must be >= 50', 'fin AND NOT exact AND psnr < 50'))} AS errors FROM v""")
def _p09(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    found = ck.tensor_gate(
        k % 11 > 0, k % 7 == 0, (k % 100) / 1000.0, (cu % 50) / 1000.0, F.when(k % 7 > 0, 30.0 + cu % 40),
        {"p99_abs": 0.05, "rmse": 0.02, "min_psnr_db": 50.0},
    )
    return t.orders.select("o_orderkey", F.array_join(found, "; ").alias("errors"))


@query("P10_output_gate", f"""
WITH v AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS exact, CASE WHEN o_orderkey % 7 > 0 THEN 30.0 + o_custkey % 40 END AS psnr,
  CASE WHEN o_orderkey % 9 > 0 THEN (o_custkey % 100) / 100.0 END AS ssim FROM orders)
SELECT o_orderkey, {errors_sql(('psnr must be >= 40', 'NOT exact AND psnr < 40'), ('ssim must be >= 0.95', 'ssim IS NULL OR ssim < 0.95'))} AS errors FROM v""")
def _p10(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    found = ck.output_gate(
        k % 7 == 0, F.when(k % 7 > 0, 30.0 + cu % 40), F.when(k % 9 > 0, (cu % 100) / 100.0),
        {"psnr_min_db": 40.0, "ssim_min": 0.95},
    )
    return t.orders.select("o_orderkey", F.array_join(found, "; ").alias("errors"))


@query("P11_report_identity_check", f"""
WITH r AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority FROM orders),
cmp AS (SELECT l_orderkey AS k, l_returnflag AS impl,
  CAST(l_linestatus <> 'O' AS INTEGER) + CAST(l_linenumber % 2 <> 0 AS INTEGER) + CAST(l_suppkey % 10 = 0 AS INTEGER) AS wrong FROM lineitem),
f AS (SELECT k, string_agg(DISTINCT impl, ',' ORDER BY impl) AS names, count(*) AS n, sum(wrong) AS changes FROM cmp GROUP BY k)
SELECT k, {errors_sql(('changed document type', "r.o_orderpriority = '5-LOW'"), ('changed status', "r.o_orderstatus <> 'F'"),
 ('changed publishable', 'r.k % 8 = 0'), ('changed contract version', 'r.k % 3 <> 0'), ('changed variant', 'r.o_custkey % 2 <> 0'),
 ('changed reference image', 'r.o_custkey % 5 <> 0'), ('comparison set changed', "names IS DISTINCT FROM 'A,R' OR n IS DISTINCT FROM 2"))} AS errors,
 CAST(coalesce(changes, 0) AS BIGINT) AS candidate_changes FROM r LEFT JOIN f USING (k)""")
def _p11(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    null = F.lit(None).cast("string")
    plain = {name: null for name in ck.REPORT_FIELDS.values()}
    actual = plain | {
        "document_type": F.when(c("o_orderpriority") == "5-LOW", "other").otherwise("inference-parity"),
        "status": c("o_orderstatus"), "publishable": k % 8 > 0, "contract_version": k % 3,
        "variant": (cu % 2).cast("string"), "reference_image_id": (cu % 5).cast("string"),
        "workload_id": F.lit("any"), "frame_indices": F.array(k),
    }
    expected = plain | {
        "document_type": F.lit("inference-parity"), "status": F.lit("F"), "publishable": F.lit(True),
        "contract_version": F.lit(0).cast("long"), "variant": F.lit("0"), "reference_image_id": F.lit("0"),
        "frame_indices": F.lit(None).cast("array<long>"),
    }
    reports = t.orders.select(
        k.alias("k"), *[v.alias(n) for n, v in actual.items()], *[v.alias(f"expected_{n}") for n, v in expected.items()],
        F.array(F.lit("A"), F.lit("R")).alias("expected_candidates"),
    )
    same = {n: F.lit("x") for n in ck.COMPARISON_FIELDS.values()}
    comparisons = t.lineitem.select(
        c("l_orderkey").alias("k"), c("l_returnflag").alias("implementation"),
        *[v.alias(n) for n, v in (same | {
            "status": c("l_linestatus"), "image_id": (c("l_linenumber") % 2).cast("string"),
            "source_dirty": F.when(c("l_suppkey") % 10 > 0, "0"),
        }).items()],
        *[v.alias(f"expected_{n}") for n, v in (same | {
            "status": F.lit("O"), "image_id": F.lit("0"), "source_dirty": F.lit("0"),
        }).items()],
    )
    return ck.report_identity_check(reports, comparisons, "k").select("k", joined(), "candidate_changes")


@query("P12_canonical_parameter_errors", f"""
WITH s AS (SELECT o_orderkey AS k, o_custkey % 30 AS w, o_orderkey % 5 * 100 AS frames, 3 AS initial_runs, o_orderkey % 3 AS extra, (o_orderkey % 10) / 100.0 AS st, 30.0 AS idle FROM orders),
n AS (SELECT n_nationkey AS w, n_regionkey * 100 AS mf, 3 AS ir, 2 AS ex, n_regionkey / 100.0 AS th, 30.0 AS idle FROM nation)
SELECT k, {errors_sql(('no canonical contract', 'mf IS NULL'), ('frames must match measured_frames', 'frames <> mf'), ('extra_runs_on_spread must match extra_runs_on_spread', 'extra <> ex'),
 ('spread_threshold must match spread_threshold', 'st <> th'), ('max_relative_spread must match spread_threshold', 'th IS NOT NULL AND th <> 0.05'))} AS errors
FROM s LEFT JOIN n USING (w)""")
def _p12(t):
    k = c("o_orderkey")
    suites = t.orders.select(
        k.alias("k"), (c("o_custkey") % 30).alias("w"),
        F.struct(
            (k % 5 * 100).alias("frames"), F.lit(3).alias("initial_runs"), (k % 3).alias("extra_runs_on_spread"),
            ((k % 10) / 100.0).alias("spread_threshold"), F.lit(0.05).alias("max_relative_spread"),
            F.lit(30.0).alias("idle_seconds"), F.lit(100).alias("nvml_sample_interval_ms"), F.lit(10).alias("warmup_frames"),
        ).alias("parameters"),
    )
    contracts = t.nation.select(
        c("n_nationkey").cast("long").alias("w"), (c("n_regionkey") * 100).cast("long").alias("measured_frames"),
        F.lit(3).alias("initial_runs"), F.lit(2).cast("long").alias("extra_runs_on_spread"),
        (c("n_regionkey") / 100.0).alias("spread_threshold"), F.lit(30.0).alias("idle_seconds"),
        F.lit(100).alias("nvml_sample_interval_ms"), F.lit(10).alias("warmup_frames"),
    )
    return ck.canonical_parameter_errors(suites, contracts, "w").select("k", joined())


@query("P13_publishability", """
WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 4 = 0 AS acc, o_custkey % 3 AS c FROM orders)
SELECT o_orderkey, concat_ws('; ', CASE WHEN c = 0 THEN 'frames must match' END, CASE WHEN acc THEN 'suite is for acceptance only' END,
 CASE WHEN o_orderstatus <> 'O' THEN 'suite status is ' || o_orderstatus END, 'run 1 reproducibility: dirty', CASE WHEN c = 1 THEN 'run 2 reproducibility: dirty' END) AS reasons FROM r""")
def _p13(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    none = F.array().cast("array<string>")
    canonical = F.when(cu % 3 == 0, F.array(F.lit("frames must match"), F.lit("frames must match"))).otherwise(none)
    run = lambda n: F.struct(F.lit(n).alias("run"), F.lit("dirty").alias("error"))
    errors = F.when(cu % 3 == 1, F.array(run(1), run(2), run(1))).otherwise(F.array(run(1), run(1)))
    status = F.when(c("o_orderstatus") == "O", "valid").otherwise(c("o_orderstatus"))
    found = R.publish_reasons(canonical, k % 4 == 0, status, errors)
    return t.orders.select("o_orderkey", F.array_join(found, "; ").alias("reasons"))


@query("P14_classify_oom", """
WITH d AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' ERROR CODE 2: outofmemory' WHEN 1 THEN ' out of memory' WHEN 2 THEN ' cudaMalloc failed: Out Of Memory'
 WHEN 3 THEN ' cudaErrorMemoryAllocation' WHEN 4 THEN ' cuda_error_out_of_memory' ELSE '' END AS x FROM documents)
SELECT doc_id, lower(x) LIKE '%error code 2: outofmemory%' OR lower(x) LIKE '%cuda\\_error\\_out\\_of\\_memory%' ESCAPE '\\' OR lower(x) LIKE '%cudaerrormemoryallocation%'
 OR (lower(x) LIKE '%cudamalloc%' AND lower(x) LIKE '%out of memory%') AS oom FROM d""")
def _p14(t):
    slot = c("doc_id") % 6
    tail = (
        F.when(slot == 0, " ERROR CODE 2: outofmemory").when(slot == 1, " out of memory")
        .when(slot == 2, " cudaMalloc failed: Out Of Memory").when(slot == 3, " cudaErrorMemoryAllocation")
        .when(slot == 4, " cuda_error_out_of_memory").otherwise("")
    )
    return t.documents.select("doc_id", R.classify_oom(F.concat("text", tail)).alias("oom"))


@query("P15_eligible_media", """
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nv12' WHEN 1 THEN 'yuv420p' WHEN 2 THEN 'p010le' END AS pix_fmt,
 CASE p_size % 5 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN 'bt709' END AS tr FROM part)
SELECT p_partkey, pix_fmt FROM v WHERE pix_fmt IN ('nv12', 'yuv420p') AND coalesce(tr NOT IN ('smpte2084', 'arib-std-b67'), true)""")
def _p15(t):
    slot, size = c("p_partkey") % 4, c("p_size") % 5
    videos = t.part.select(
        "p_partkey",
        F.when(slot == 0, "nv12").when(slot == 1, "yuv420p").when(slot == 2, "p010le").alias("pix_fmt"),
        F.when(size == 0, "smpte2084").when(size == 1, "arib-std-b67").when(size == 2, "bt709").alias("color_transfer"),
    )
    return ck.eligible_media(videos).select("p_partkey", "pix_fmt")


# (label, divisor): the rule is broken where the part key is a multiple of the divisor.
DEFECTS = [
    ("unsupported schema_version", 7), ("id is required", 11), ("lock_path must stay inside", 13),
    ("benchmark.contract_version must be positive", 17), ("benchmark.warmup_frames must be positive", 19),
    ("benchmark.measured_frames must be positive", 23), ("benchmark.initial_runs must be positive", 29),
    ("benchmark.nvml_sample_interval_ms must be positive", 31), ("benchmark.extra_runs_on_spread must not be negative", 37),
    ("benchmark.spread_threshold must be in [0, 1)", 41), ("benchmark.idle_seconds must not be negative", 43),
    ("model.source.url must be https", 5), ("model.source.sha256 must be lowercase sha256", 47),
    ("model.source.size_bytes must be positive", 53), ("model.source.license_reference is required", 59),
    ("model.source.attribution is required", 61), ("model.export_name is required", 67), ("model.scale must be positive", 71),
    ("model.weights_path must stay inside", 73), ("model.onnx_dir must stay inside", 79),
    ("clip.source_path must stay inside", 83), ("clip.frames must be 1000", 89),
    ("quality.model_space.frame_indices must be sorted and unique", 3), ("quality.model_space.frame_indices must stay inside the clip", 89),
    ("quality.model_space.contract_version must be 3", 97), ("quality.model_space.p99_abs must be positive", 101),
    ("quality.model_space.rmse must be positive", 103), ("quality.model_space.min_psnr_db must be positive", 107),
    ("quality.product_output.frame_indices must be a non-empty integer array", 9), ("psnr_min_db must be positive", 109),
    ("ssim_min must be in (0, 1]", 113), ("crop is invalid", 127), ("crop exceeds the output frame", 131),
    ("clip.fps must be positive", 137), ("temporal_sampling.source_fps must be positive", 139),
    ("temporal_sampling cannot raise the rate", 149), ("temporal_sampling.method must be drop", 151),
    ("temporal_sampling.round must be near", 157), ("clip.encode.b_frames must not be negative", 163),
    ("model variant names must be unique", 167), ("model variant has invalid size", 173),
    ("clip variant has invalid size", 179), ("clip variant has invalid bitrate", 181),
    ("model and clip variants differ", 191),
]


def workloads(t):
    """Workload documents, one per part, each with the defects its key selects."""
    k = c("p_partkey")
    hit = dict(DEFECTS)
    bad = lambda label: (k % hit[label] == 0)
    spoil = lambda label, wrong, right: F.when(bad(label), wrong).otherwise(right)
    none_text = F.lit(None).cast("string")
    num = lambda f: spoil(f"benchmark.{f} must be positive", F.lit(0), F.lit(5)).alias(f)

    def source(name):
        own = name == "model.source"
        pick = (lambda rule, w, r: spoil(f"{name}.{rule}", w, r)) if own else (lambda rule, w, r: r)
        return F.struct(
            pick("url must be https", F.lit("http://x.example/a"), F.lit("https://x.example/a")).alias("url"),
            pick("sha256 must be lowercase sha256", F.upper(F.sha2("p_name", 256)), F.sha2("p_name", 256)).alias("sha256"),
            pick("size_bytes must be positive", F.lit(0), F.lit(9)).alias("size_bytes"),
            pick("license_reference is required", none_text, F.lit("CC0")).alias("license_reference"),
            pick("attribution is required", F.lit(""), F.lit("someone")).alias("attribution"),
        )

    path = lambda rule, wrong: spoil(rule, F.lit(wrong), F.lit("a/b"))
    long_frames = F.array(F.lit(1), F.lit(5), F.lit(999))
    crop = F.struct(
        spoil("crop is invalid", F.lit(""), F.lit("centre")).alias("name"), F.lit(0.25).alias("x"), F.lit(0.25).alias("y"),
        spoil("crop exceeds the output frame", F.lit(0.9), F.lit(0.5)).alias("width"), F.lit(0.5).alias("height"),
    )
    variant = lambda name, width: F.struct(
        name.alias("name"), width.alias("input_width"), F.lit(720).alias("input_height"),
        width.alias("width"), F.lit(720).alias("height"), F.lit(35.0).alias("bitrate_mbps"),
    )
    zero = lambda label: spoil(label, F.lit(0), F.lit(1280))
    sampling = F.struct(
        F.when(bad("temporal_sampling.source_fps must be positive"), "0/1")
        .when(bad("temporal_sampling cannot raise the rate"), "12/1").otherwise("24000/1001").alias("source_fps"),
        spoil("temporal_sampling.method must be drop", F.lit("blend"), F.lit("drop")).alias("method"),
        spoil("temporal_sampling.round must be near", F.lit("up"), F.lit("near")).alias("round"),
    )
    limits = F.struct(*[
        spoil(f"quality.model_space.{f} must be positive", F.lit(0.0), F.lit(1.0)).alias(f) for f in ("p99_abs", "rmse", "min_psnr_db")
    ])
    return t.part.select(
        k.alias("k"),
        spoil("unsupported schema_version", F.lit(2), F.lit(1)).alias("schema_version"),
        spoil("id is required", F.lit(""), c("p_name")).alias("id"),
        path("lock_path must stay inside", "/etc/lock").alias("lock_path"),
        F.struct(
            *[num(f) for f in ("contract_version", "warmup_frames", "measured_frames", "initial_runs", "nvml_sample_interval_ms")],
            spoil("benchmark.extra_runs_on_spread must not be negative", F.lit(-1), F.lit(0)).alias("extra_runs_on_spread"),
            spoil("benchmark.spread_threshold must be in [0, 1)", F.lit(1.0), F.lit(0.0)).alias("spread_threshold"),
            spoil("benchmark.idle_seconds must not be negative", F.lit(-0.5), F.lit(0.0)).alias("idle_seconds"),
        ).alias("benchmark"),
        F.struct(
            source("model.source").alias("source"),
            spoil("model.export_name is required", F.lit(""), F.lit("net")).alias("export_name"),
            spoil("model.scale must be positive", F.lit(0), F.lit(2)).alias("scale"),
            path("model.weights_path must stay inside", "a/../../b").alias("weights_path"),
            path("model.onnx_dir must stay inside", "").alias("onnx_dir"),
            F.array(
                variant(F.lit("720p"), zero("model variant has invalid size")),
                variant(F.when(bad("model variant names must be unique"), "720p").otherwise("1080p"), F.lit(1920)),
            ).alias("variants"),
        ).alias("model"),
        F.struct(
            source("clip.source").alias("source"),
            path("clip.source_path must stay inside", "..").alias("source_path"),
            spoil("clip.frames must be 1000", F.lit(900), F.lit(1000)).alias("frames"),
            spoil("clip.fps must be positive", F.lit("0/1"), F.lit("19001/1000")).alias("fps"),
            sampling.alias("temporal_sampling"),
            F.struct(spoil("clip.encode.b_frames must not be negative", F.lit(-1), F.lit(2)).alias("b_frames")).alias("encode"),
            F.array(
                variant(F.lit("720p"), zero("clip variant has invalid size")).withField(
                    "bitrate_mbps", spoil("clip variant has invalid bitrate", F.lit(0.0), F.lit(35.0))),
                variant(
                    F.when(bad("model and clip variants differ"), "2160p").when(bad("model variant names must be unique"), "720p2").otherwise("1080p"),
                    F.lit(1920)),
            ).alias("variants"),
        ).alias("clip"),
        F.struct(
            F.struct(
                spoil("quality.model_space.frame_indices must be sorted and unique",
                      F.array(F.lit(1), F.lit(999), F.lit(5)), long_frames).alias("frame_indices"),
                spoil("quality.model_space.contract_version must be 3", F.lit(2), F.lit(3)).alias("contract_version"),
                limits.alias("thresholds"),
            ).alias("model_space"),
            F.struct(
                spoil("quality.product_output.frame_indices must be a non-empty integer array",
                      F.array().cast("array<int>"), F.array(F.lit(0), F.lit(7))).alias("frame_indices"),
                F.struct(
                    spoil("psnr_min_db must be positive", F.lit(0.0), F.lit(40.0)).alias("psnr_min_db"),
                    spoil("ssim_min must be in (0, 1]", F.lit(1.5), F.lit(1.0)).alias("ssim_min"),
                ).alias("thresholds"),
                F.array(crop).alias("crops"),
            ).alias("product_output"),
        ).alias("quality"),
    )


def _defect_sql(label: str, divisor: int) -> tuple[str, str]:
    cond = f"p_partkey % {divisor} = 0"
    if label == "crop exceeds the output frame":
        cond += " AND p_partkey % 127 <> 0"
    elif label == "temporal_sampling cannot raise the rate":
        # A zero source rate is also below a positive target; a zero target is below nothing.
        cond = "(p_partkey % 139 = 0 OR p_partkey % 149 = 0) AND p_partkey % 137 <> 0"
    elif label == "model and clip variants differ":
        cond += " OR p_partkey % 167 = 0"
    return label, cond


@query("P16_manifest_rule_errors", f"SELECT p_partkey AS k, {errors_sql(*[_defect_sql(*d) for d in DEFECTS])} AS errors FROM part")
def _p16(t):
    return ck.manifest_rule_errors(workloads(t)).select("k", joined())


@query("P17_path_contained", """
WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN replace(url, '//', '/../') WHEN 3 THEN replace(url, '/', '..') ELSE '' END AS p FROM pages)
SELECT page_id, p <> '' AND left(p, 1) <> '/' AND NOT list_contains(string_split(p, '/'), '..') AS inside FROM v""")
def _p17(t):
    slot, url = c("page_id") % 5, c("url")
    rep = lambda a, b: F.replace(url, F.lit(a), F.lit(b))
    path = F.when(slot == 0, url).when(slot == 1, F.concat(F.lit("/"), url)).when(slot == 2, rep("//", "/../")).when(
        slot == 3, rep("/", "..")).otherwise("")
    return t.pages.select("page_id", R.path_contained(path).alias("inside"))


@query("P18_redact_paths", """
WITH v AS (SELECT page_id, rtrim(substring(url, position('//' IN url) + 2), '/') AS u FROM pages)
SELECT page_id, concat_ws(' ', '-i', u, 'external/' || regexp_extract(u, '[^/]*$')) AS command FROM v""")
def _p18(t):
    tail = F.expr("substring(url, locate('//', url) + 2)")
    command = F.array(F.lit("-i"), F.concat(F.lit("/srv/data/"), tail), F.concat(F.lit("/home/me/"), tail))
    return t.pages.select("page_id", F.array_join(R.redact_command(command, "/srv/data"), " ").alias("command"))


@query("P19_resolve_parameters", f"""
WITH v AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 1000 ELSE 1000 END AS frames, 10 AS warmup_frames, 3 AS initial_runs,
  CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 2 END AS extra_runs_on_spread, 30.0 AS idle_seconds, (o_orderkey % 11) / 100.0 AS st,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7) / 6.0 ELSE 0.05 END AS mx FROM orders)
SELECT k, CAST(frames AS BIGINT) AS frames, CAST(extra_runs_on_spread AS BIGINT) AS extra_runs_on_spread, round(st, 6) AS spread_threshold, round(mx, 6) AS max_relative_spread,
 {errors_sql(('invalid value for extra_runs_on_spread', 'extra_runs_on_spread < 0'), ('frames must be greater than zero', 'frames = 0'),
 ('spread thresholds must satisfy 0 <= extension <= maximum < 1', 'NOT (st <= mx AND mx < 1)'))} AS errors FROM v""")
def _p19(t):
    k = c("o_orderkey")
    null = F.lit(None)
    df = t.orders.select(
        k.alias("k"),
        F.struct(
            F.when(k % 3 == 0, 0).when(k % 3 == 1, k % 1000).cast("long").alias("frames"), null.cast("long").alias("warmup_frames"),
            null.cast("long").alias("initial_runs"), F.when(k % 5 == 0, -1).cast("long").alias("extra_runs_on_spread"),
            null.cast("double").alias("idle_seconds"), ((k % 11) / 100.0).alias("spread_threshold"),
            F.when(k % 2 == 0, (k % 7) / 6.0).alias("max_relative_spread"),
        ).alias("override"),
        F.struct(
            F.lit(1000).cast("long").alias("measured_frames"), F.lit(10).cast("long").alias("warmup_frames"), F.lit(3).cast("long").alias("initial_runs"),
            F.lit(2).cast("long").alias("extra_runs_on_spread"), F.lit(30.0).alias("idle_seconds"), F.lit(0.05).alias("spread_threshold"),
        ).alias("contract"),
    )
    out = ck.resolve_parameters(df)
    return out.select("k", "frames", "extra_runs_on_spread", F.round("spread_threshold", 6).alias("spread_threshold"),
                      F.round("max_relative_spread", 6).alias("max_relative_spread"), joined())


@query("P20_resolve_profile", f"""
WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS i, CASE o_custkey % 3 WHEN 0 THEN 'tuned' WHEN 1 THEN 'upstream-default' ELSE 'other' END AS p,
  CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN '4' END AS req, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS ns,
  CASE o_orderkey % 7 WHEN 0 THEN 'auto' WHEN 1 THEN '4' WHEN 2 THEN '8' END AS th, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 11 = 1 END AS g FROM orders),
q AS (SELECT *, p = 'tuned' AS t, p = 'upstream-default' AS d, TRY_CAST(nullif(req, 'auto') AS INTEGER) AS rv, TRY_CAST(nullif(th, 'auto') AS INTEGER) AS tv,
  CASE WHEN i = 'left' THEN 1 ELSE 4 END AS pns, CASE WHEN i = 'right' THEN 4 END AS pth FROM v)
SELECT k, CAST(CASE WHEN t THEN rv END AS BIGINT) AS requests, CAST(CASE WHEN t THEN ns WHEN d THEN pns END AS BIGINT) AS num_streams,
 CAST(CASE WHEN t THEN tv WHEN d THEN pth END AS BIGINT) AS threads, CASE WHEN t THEN g WHEN d THEN false END AS cuda_graph,
 {errors_sql(('unknown profile', 'NOT t AND NOT d'), ('profile fixes requests', 'd AND req IS NOT NULL AND rv IS NOT NULL'),
 ('profile fixes num_streams', 'd AND ns IS NOT NULL AND ns <> pns'), ('profile fixes threads', 'd AND th IS NOT NULL AND tv IS DISTINCT FROM pth'),
 ('profile fixes cuda_graph', 'd AND g'), ('tuned requires requests', 't AND req IS NULL'), ('tuned requires num_streams', 't AND ns IS NULL'),
 ('tuned requires threads', 't AND th IS NULL'), ('tuned requires cuda_graph', 't AND g IS NULL'))} AS errors FROM q""")
def _p20(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    df = t.orders.select(
        k.alias("k"), F.when(k % 2 == 0, "left").otherwise("right").alias("implementation"),
        F.when(cu % 3 == 0, "tuned").when(cu % 3 == 1, "upstream-default").otherwise("other").alias("execution_profile"),
        F.when(k % 3 == 0, "auto").when(k % 3 == 1, "4").alias("requests"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("num_streams"),
        F.when(k % 7 == 0, "auto").when(k % 7 == 1, "4").when(k % 7 == 2, "8").alias("threads"),
        F.when(k % 11 > 0, k % 11 == 1).alias("cuda_graph"),
    )
    presets = t.spark.createDataFrame(
        [("left", "upstream-default", None, 1, None, False), ("right", "upstream-default", None, 4, 4, False)],
        "implementation string, execution_profile string, p_requests int, p_num_streams int, p_threads int, p_cuda_graph boolean",
    )
    out = ck.resolve_profile(df, presets)
    big = lambda n: c(f"resolved_{n}").cast("long").alias(n)
    return out.select("k", big("requests"), big("num_streams"), big("threads"), c("resolved_cuda_graph").alias("cuda_graph"), joined())


@query("P21_compact_candidate", """SELECT p_brand || '-s' || p_size || '-' || p_partkey AS candidate_id, p_brand AS implementation, CASE WHEN p_size > 40 THEN 'disqualified' ELSE 'eligible' END AS status,
 p_retailprice AS fps_median, round(p_size / 1000.0, 6) AS fps_spread, CASE WHEN p_size > 40 THEN 'too large' ELSE '' END AS errors FROM part""")
def _p21(t):
    big = c("p_size") > 40
    df = t.part.select(
        F.concat_ws("-", "p_brand", F.concat(F.lit("s"), c("p_size").cast("string")), c("p_partkey").cast("string")).alias("candidate_id"),
        c("p_brand").alias("implementation"), F.when(big, "disqualified").otherwise("eligible").alias("status"),
        F.struct(c("p_retailprice").alias("median_fps"), F.round(c("p_size") / 1000.0, 6).alias("relative_spread"),
                 c("p_retailprice").alias("median_wall_time_sec")).alias("statistics"),
        F.when(big, F.array(F.lit("too large"))).alias("errors"), c("p_type").alias("runner_arguments"),
    )
    return ck.compact_candidate(df).select("candidate_id", "implementation", "status", "fps_median", "fps_spread", joined())


@query("P22_engine_contract_errors", f"""SELECT p_partkey AS k, {errors_sql(('engine hash does not match sidecar', 'p_partkey % 7 = 0'), ('invalid static input shape', 'p_partkey % 11 = 0'),
 ('invalid static output shape', 'p_size - 5 <= 0'), ('input shape does not match workload', 'p_partkey % 11 = 0 OR p_partkey % 3 = 0'),
 ('bindings must be fp32', 'p_partkey % 5 = 0'), ('input profile must be absent', 'p_partkey % 13 = 0'), ('engine was not built from the canonical model', 'p_partkey % 17 = 0'),
 ('engine must be strongly typed', 'p_partkey % 2 = 0'), ('engine builder version is not the pinned one', 'p_size % 3 = 0'), ('builder and runtime image differ', 'p_size % 4 = 0'))} AS errors FROM part""")
def _p22(t):
    k, size = c("p_partkey"), c("p_size")
    dims = lambda *v: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    sha = lambda bad: F.when(bad, "changed").otherwise(F.sha2("p_name", 256))
    given = F.when(k % 11 == 0, dims(1, 3, size)).otherwise(dims(1, 3, size, size * 2))
    df = t.part.select(
        k.alias("k"), F.sha2("p_name", 256).alias("engine_sha256"), sha(k % 7 == 0).alias("actual_engine_sha256"), given.alias("input_shape"),
        dims(1, 3, size - 5, size * 4).alias("output_shape"), F.when(k % 3 == 0, dims(1, 3, size + 1, size * 2)).otherwise(dims(1, 3, size, size * 2)).alias("expected_input_shape"),
        dims(1, 3, size - 5, size * 4).alias("expected_output_shape"), F.when(k % 5 == 0, "fp16").otherwise("fp32").alias("io_precision"),
        F.when(k % 13 == 0, "min").alias("input_profile"), sha(k % 17 == 0).alias("model_sha256"), F.sha2("p_name", 256).alias("expected_model_sha256"),
        F.array(F.when(k % 2 == 1, "stronglyTyped").otherwise("fp16")).alias("builder_flags"), F.when(size % 3 == 0, "11.0.1").otherwise("10.16.0").alias("builder_version"),
        F.lit("base").alias("runtime_base_image"), F.lit("base").alias("expected_base_image"), F.when(size % 4 == 0, "old").otherwise("base").alias("builder_base_image"),
        F.lit("p1").alias("runtime_package"), F.lit("p1").alias("expected_package"),
    )
    return ck.pinned_engine_errors(ck.engine_contract_errors(df), "1016").select("k", joined())


@query("P23_upscale_shape_errors", f"""
WITH s AS (SELECT p_partkey AS k, p_partkey % 19 > 0 AS rank, p_size - 2 AS a2, p_size + 1 AS a3, CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 3 END AS ch,
  (p_size - 2) * 2 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS b2, (p_size + 1) * (1 + p_partkey % 2) AS b3 FROM part),
q AS (SELECT *, rank AND a2 > 0 AND b2 > 0 AS st FROM s), w AS (SELECT *, CASE WHEN st THEN b2 % a2 = 0 AND b3 % a3 = 0 END AS whole, b2 * a3 = b3 * a2 AS uni FROM q)
SELECT k, CAST(CASE WHEN st AND n = 1 AND ch = 3 AND whole AND uni THEN b2 // a2 END AS BIGINT) AS scale,
 {errors_sql(('tensors must have rank 4', 'NOT rank'), ('shapes must be static and positive', 'rank AND NOT st'), ('batch must be 1', 'st AND n <> 1'), ('tensors must have 3 channels', 'st AND ch <> 3'),
 ('output must be a whole multiple of input', 'st AND NOT whole'), ('scale must be uniform', 'st AND whole AND NOT uni'))} AS errors FROM w""")
def _p23(t):
    k, size = c("p_partkey"), c("p_size")
    n, ch = F.when(k % 13 == 0, 2).otherwise(1), F.when(k % 7 == 0, 4).otherwise(3)
    full = F.array(n, ch, size - 2, size + 1)
    df = t.part.select(
        k.alias("k"), F.when(k % 19 == 0, F.array(n, ch)).otherwise(full).alias("input_shape"),
        F.array(n, ch, (size - 2) * 2 + F.when(k % 11 == 0, 1).otherwise(0), (size + 1) * (1 + (k % 2).cast("int"))).alias("output_shape"),
    )
    return ck.upscale_shape_errors(df).select("k", "scale", joined())


@query("P24_conformance_errors", f"""
WITH v AS (SELECT o_orderkey AS k, o_custkey AS cu, CASE WHEN o_orderkey % 23 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 20 - 1) / 100000.0 END AS mx,
  (o_custkey % 3) / 150000.0 AS rm, 70.0 + o_custkey % 30 AS ps FROM orders)
SELECT k, {errors_sql(('field schema_version is wrong', 'k % 7 = 0'), ('field status is wrong', 'k % 11 = 0'), ('source model identity does not match', 'k % 13 = 0'),
 ('model scale is invalid', 'cu % 5 = 0'), ('model scale is not the expected one', 'cu % 5 NOT IN (0, 2)'), ('probe version does not match', 'k % 17 = 0'),
 ('probe input shape does not match', 'k % 19 = 0'), ('probe output shape does not match the scale', 'cu % 5 <> 2'),
 ('metric max_abs is invalid', 'isnan(mx)'), ('error metrics cannot be negative', 'mx < 0'), ('max_abs exceeds its threshold', 'NOT isnan(mx) AND mx > 1e-4'),
 ('rmse exceeds its threshold', 'rm > 1e-5'), ('psnr_db is below its threshold', 'ps < 80'))} AS errors FROM v""")
def _p24(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    constants = {n: F.lit(v) for n, v in ck.EXPORT_CONSTANTS.items()}
    constants["schema_version"] = F.when(k % 7 == 0, 1).otherwise(2)
    constants["status"] = F.when(k % 11 == 0, "invalid").otherwise("valid")
    df = t.orders.select(
        k.alias("k"), *[v.alias(n) for n, v in constants.items()],
        F.lit("net").alias("model_name"), F.lit("net").alias("expected_name"), F.when(k % 13 == 0, "x").otherwise("y").alias("source_sha256"), F.lit("y").alias("expected_sha256"),
        F.lit(9).alias("source_size_bytes"), F.lit(9).alias("expected_size_bytes"), (cu % 5).alias("scale"), F.lit(2).cast("long").alias("expected_scale"),
        F.when(k % 17 == 0, "v0").otherwise(ck.EXPORT_PROBE_VERSION).alias("probe_version"),
        F.when(k % 19 == 0, longs(1, 3, 8, 8)).otherwise(longs(1, 3, 16, 16)).alias("probe_input_shape"), longs(1, 3, 32, 32).alias("probe_output_shape"),
        F.when(k % 23 == 0, F.lit(float("nan"))).otherwise((k % 20 - 1) / 100000.0).alias("max_abs"), F.lit(0.0).alias("mean_abs"),
        ((cu % 3) / 150000.0).alias("rmse"), F.lit(0.0).alias("relative_l2"), (70.0 + cu % 30).alias("psnr_db"),
    )
    return ck.conformance_errors(df).select("k", joined())


@query("P25_timing_contract_errors", f"""
WITH v AS (SELECT o_orderkey AS k, o_custkey AS cu, o_totalprice AS w, o_totalprice + CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0005 ELSE 0 END AS total, CASE WHEN o_custkey % 3 = 0 THEN 0.25 ELSE 0 END AS extra FROM orders)
SELECT k, {errors_sql(('no CPU accounting method', 'k % 5 = 0'), ('invalid logical CPU count', 'cu % 9 = 0'), ('invalid lifecycle timing contract', 'k % 7 = 0'),
 ('scopes do not cover wall time', 'k % 4 = 0'), ('scopes do not sum to total', 'cu % 3 = 0'))} AS errors FROM v""")
def _p25(t):
    k, cu, w = c("o_orderkey"), c("o_custkey"), c("o_totalprice")
    total = w + F.when(k % 4 == 0, 0.5).when(k % 4 == 1, 0.0005).otherwise(0.0)
    df = t.orders.select(
        k.alias("k"), w.alias("wall_time_sec"),
        F.struct(F.when(k % 5 > 0, "rusage").otherwise("").alias("accounting"), F.lit("child").alias("scope"), (cu % 9).alias("available_logical_cpus")).alias("cpu"),
        F.struct(
            F.when(k % 7 > 0, "monotonic").alias("clock"), F.lit("v1").alias("boundary_contract"), total.alias("total_sec"),
            F.lit(1.0).alias("startup_sec"), (total - 3.0).alias("steady_state_frame_loop_sec"),
            (2.0 + F.when(cu % 3 == 0, 0.25).otherwise(0.0)).alias("finalize_mux_sec"),
        ).alias("lifecycle"),
    )
    return ck.timing_contract_errors(df).select("k", joined())


@query("P26_search_suite_errors", f"""
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'reconnaissance' ELSE 'confirmation' END AS stage, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 100 ELSE 200 END AS frames,
  30 AS idle, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS med, (o_orderkey % 12) / 100.0 AS spread FROM orders),
p AS (SELECT 'reconnaissance' AS stage, 200 AS mf, 1 AS ir, 0 AS ex, 0.02 AS th, 0.05 AS mx, 30 AS idle UNION ALL SELECT 'confirmation', 200, 3, 2, 0.02, 0.08, 60),
r AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_returnflag) AS keys FROM lineitem GROUP BY 1)
SELECT k, {errors_sql(('suite status is not valid', "o_orderstatus <> 'O'"), ('changed stage parameters: frames, idle_seconds', 'frames <> mf AND s.idle <> p.idle'),
 ('changed stage parameters: frames', 'frames <> mf AND s.idle = p.idle'), ('changed stage parameters: idle_seconds', 'frames = mf AND s.idle <> p.idle'),
 ('median must be positive and finite', 'med <= 0'), ('spread exceeds the limit', 'spread > mx'), ('run count does not match the spread policy', 'coalesce(n, 0) <> ir + CASE WHEN spread > th THEN ex ELSE 0 END'),
 ('runs changed immutable evidence', 'keys > 1'))} AS errors FROM s JOIN p USING (stage) LEFT JOIN r USING (k)""")
def _p26(t):
    k = c("o_orderkey")
    suites = t.orders.select(
        k.alias("k"), F.when(c("o_custkey") % 2 == 0, "reconnaissance").otherwise("confirmation").alias("stage"),
        F.when(c("o_orderstatus") == "O", "valid").otherwise("unstable").alias("status"),
        F.struct(
            F.when(k % 6 == 0, 100).otherwise(200).alias("frames"), F.lit(10).alias("warmup_frames"),
            F.when(c("o_custkey") % 2 == 0, 1).otherwise(3).alias("initial_runs"), F.when(c("o_custkey") % 2 == 0, 0).otherwise(2).alias("extra_runs_on_spread"),
            F.lit(0.02).alias("spread_threshold"), F.when(c("o_custkey") % 2 == 0, 0.05).otherwise(0.08).alias("max_relative_spread"),
            F.lit(30).alias("idle_seconds"), F.lit("diagnostic").alias("bitrate_validation"),
        ).alias("parameters"),
        F.when(k % 10 == 0, 0.0).otherwise(c("o_totalprice")).alias("median_fps"), ((k % 12) / 100.0).alias("relative_spread"),
    )
    policies = t.spark.createDataFrame(
        [("reconnaissance", 200, 10, 1, 0, 0.02, 0.05, 30, "diagnostic"), ("confirmation", 200, 10, 3, 2, 0.02, 0.08, 60, "diagnostic")],
        "stage string, measured_frames int, warmup_frames int, initial_runs int, extra_runs_on_spread int, spread_threshold double, max_relative_spread double, idle_seconds int, bitrate_validation string",
    )
    runs = t.lineitem.select(c("l_orderkey").alias("k"), c("l_returnflag").alias("implementation_key"))
    return ck.search_suite_errors(suites, runs, policies, "k", "stage").select("k", joined())


@query("P27_capture_errors", f"""
WITH a AS (SELECT vec_id // 8 AS cap, vec_id % 4 AS frame_index, CASE WHEN vec_id // 4 % 2 = 0 THEN 'input' ELSE 'output' END AS stage, CASE WHEN vec_id % 37 = 0 THEN 10 ELSE 64 END AS len FROM embeddings
  UNION ALL SELECT vec_id // 8, vec_id % 4, CASE WHEN vec_id // 4 % 2 = 0 THEN 'input' ELSE 'output' END, 64 FROM embeddings WHERE label = 3),
cells AS (SELECT cap, frame_index, stage, count(*) AS n, count(*) FILTER (len <> 64) AS bad FROM a GROUP BY 1, 2, 3),
f AS (SELECT cap, max(n) AS most, sum(bad) AS hashes, count(DISTINCT frame_index) AS frames, count(*) FILTER (stage = 'input') AS i, count(*) FILTER (stage = 'output') AS o FROM cells GROUP BY 1),
k AS (SELECT DISTINCT vec_id // 8 AS cap FROM embeddings),
v AS (SELECT cap, CASE cap % 4 WHEN 0 THEN 'production-reference' WHEN 1 THEN 'production-preprocessing' WHEN 2 THEN 'shared-input-inference' ELSE 'other' END AS scope FROM k)
SELECT cap, {errors_sql(('unknown capture scope', "scope = 'other'"), ('workload identity is required', 'cap % 5 = 0'), ('engine checksum is invalid', 'cap % 7 = 0'),
 ('no canonical input checksum', "scope = 'shared-input-inference' AND cap % 3 = 0"), ('only shared-input captures may name a canonical input', "scope <> 'shared-input-inference' AND cap % 3 > 0"),
 ('tensor checksum is invalid', 'hashes > 0'), ('duplicate tensors', 'most > 1'),
 ('incomplete tensor set', "scope <> 'other' AND NOT (i = frames AND o = CASE WHEN scope = 'production-preprocessing' THEN 0 ELSE frames END)"))} AS errors FROM v JOIN f USING (cap)""")
def _p27(t):
    e = t.embeddings.withColumn("cap", F.floor(c("vec_id") / 8))
    sha = F.sha2(c("vec_id").cast("string"), 256)
    stage = F.when(F.floor(c("vec_id") / 4) % 2 == 0, "input").otherwise("output")
    artifacts = e.select(
        "cap", (c("vec_id") % 4).alias("frame_index"), stage.alias("stage"),
        F.when(c("vec_id") % 37 == 0, F.substring(sha, 1, 10)).otherwise(sha).alias("sha256"), "label",
    )
    twice = artifacts.filter("label = 3").withColumn("sha256", F.sha2("stage", 256))
    slot = c("cap") % 4
    full = F.sha2(F.lit("x"), 256)
    captures = e.select("cap").distinct().select(
        "cap", F.lit("left").alias("implementation"),
        F.when(slot == 0, "production-reference").when(slot == 1, "production-preprocessing").when(slot == 2, "shared-input-inference").otherwise("other").alias("capture_scope"),
        F.when(c("cap") % 5 > 0, "w").alias("workload_id"), F.lit("720p").alias("variant"), full.alias("input_sha256"), full.alias("onnx_sha256"),
        F.when(c("cap") % 7 > 0, full).otherwise("short").alias("engine_sha256"), F.when(c("cap") % 3 > 0, full).alias("canonical_input_manifest_sha256"),
    )
    return ck.capture_errors(captures, artifacts.unionByName(twice), "cap").select("cap", joined())


@query("P28_classify_tool_text", """
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS rc, CASE doc_id % 5 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN 'SKIPPED: ' || text WHEN 2 THEN text || ' GPU video accelerator tracing is NOT available' ELSE text END AS x, doc_id % 2 = 0 AS opt FROM documents)
SELECT doc_id, CASE WHEN rc <> 0 THEN 'failed' WHEN lower(x) LIKE '%could not find any nvidia gpus%' OR lower(x) LIKE '%gpu video accelerator tracing is not available%' THEN 'unavailable'
 WHEN (trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' OR x LIKE '%SKIPPED:%') AND NOT opt THEN 'empty' ELSE 'ok' END AS class FROM v""")
def _p28(t):
    slot = c("doc_id") % 5
    text = (
        F.when(slot == 0, "  \n").when(slot == 1, F.concat(F.lit("SKIPPED: "), "text"))
        .when(slot == 2, F.concat("text", F.lit(" GPU video accelerator tracing is NOT available"))).otherwise(c("text"))
    )
    code = F.when(c("doc_id") % 9 == 0, 1).otherwise(0)
    return t.documents.select("doc_id", R.tool_text_class(code, text, c("doc_id") % 2 == 0).alias("class"))


@query("P29_failure_class", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'valid' WHEN o_custkey % 3 = 0 THEN 'infrastructure' ELSE 'candidate' END AS class FROM orders""")
def _p29(t):
    frame = F.concat(F.lit("output frame "), c("o_orderkey").cast("string"), F.lit(": rmse"))
    errors = F.when(c("o_custkey") % 3 == 0, F.array(frame, F.lit("workload differs"))).otherwise(F.array(frame))
    return t.orders.select("o_orderkey", R.failure_class(errors, c("o_orderstatus") == "O").alias("class"))
