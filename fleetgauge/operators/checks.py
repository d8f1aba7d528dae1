"""Row-wise contract checks over run manifests, workloads, engines and reports.

Each function appends an ordered ``errors`` array (see ``functions.rules``).  Small
contracts are joined by the caller; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.functions import scalars as sc

PROFILE_FIELDS = ("execution_profile", "vspipe_requests", "num_streams", "vapoursynth_threads", "cuda_graph")
IDENTITY_FIELDS = (
    "workload_id", "variant", "benchmark_contract_version", "input_sha256", "onnx_sha256", "engine_sha256",
    "workload_sha256", "image_id", "repository_revision", "environment", "frames", "warmup_frames", "encoder",
)
# Field sets of the four composite keys.
SESSION_KEY = (
    "workload_id", "variant", "benchmark_contract_version", "input_sha256", "onnx_sha256",
    "workload_sha256", "repository_revision", "environment", "encoder",
)
SHARED_MODEL_KEY = (*SESSION_KEY, "frames", "warmup_frames")
PER_IMPLEMENTATION = ("engine_sha256", "image_id")


def extract_identity(
    runs: DataFrame,
    checksum_length: int | None = None,
    require_workload: bool = True,
    require_warmup: bool = True,
    require_hardware: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The 13 identity fields of each run manifest plus the structural ``errors``."""
    c = F.col
    image = "environment.image"
    sha = lambda name: c(f"assets.{name}.sha256")
    bad_sha = lambda name: ~R.checksum_ok(sha(name), checksum_length)
    warmup = c("parameters.warmup_frames")
    rules: list[R.Rule] = [
        ("no environment contract", c("environment").isNull()),
        ("no parameters", c("parameters").isNull()),
        ("no image identity", c(image).isNull()),
    ]
    if require_hardware:
        rules += [("no GPU contract", c("environment.gpu").isNull()), ("no CPU contract", c("environment.cpu").isNull())]
    rules += [
        ("no encoder contract", c("parameters.encoder").isNull()),
        ("no workload id", R.blank(c("workload_id"))),
        ("no variant", R.blank(c("variant"))),
        ("no image id", R.blank(c(f"{image}.id"))),
        ("no repository revision", R.blank(c(f"{image}.repository_revision"))),
        ("built from dirty source", R.differs(c(f"{image}.source_dirty"), F.lit("0"))),
        ("invalid measured frame count", ~R.positive(c("parameters.frames"))),
        ("invalid warm-up frame count", ~R.positive(warmup) if require_warmup else R.when_present(warmup < 0)),
    ]
    if require_workload:
        rules.append(("no valid workload_manifest checksum", bad_sha("workload_manifest")))
    rules += [
        ("no valid contract version", ~R.positive(c("benchmark_contract_version"))),
        *[(f"no valid {n} checksum", bad_sha(n)) for n in ("input", "onnx", "engine")],
    ]
    hardware = F.when(
        c("environment.gpu").isNotNull() & c("environment.cpu").isNotNull(),
        F.to_json(F.struct(c("environment.cpu").alias("cpu"), c("environment.gpu").alias("gpu"))),
    )
    return runs.select(
        *keep,
        "workload_id",
        "variant",
        "benchmark_contract_version",
        sha("input").alias("input_sha256"),
        sha("onnx").alias("onnx_sha256"),
        sha("engine").alias("engine_sha256"),
        (sha("workload_manifest") if require_workload else F.lit(None).cast("string")).alias("workload_sha256"),
        c(f"{image}.id").alias("image_id"),
        c(f"{image}.repository_revision").alias("repository_revision"),
        hardware.alias("environment"),
        c("parameters.frames").alias("frames"),
        warmup.alias("warmup_frames"),
        F.to_json("parameters.encoder").alias("encoder"),
        R.labels(rules).alias("errors"),
    )


def key_of(fields: tuple[str, ...]) -> Column:
    """SHA-256 over the named columns in order; null has its own mark."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("∅")) for n in fields]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def identity_keys(identities: DataFrame) -> DataFrame:
    """Add the shared-model, implementation, session and session-implementation keys."""
    return identities.withColumns(
        {
            "shared_model_key": key_of(SHARED_MODEL_KEY),
            "implementation_key": key_of((*SHARED_MODEL_KEY, *PER_IMPLEMENTATION)),
            "session_key": key_of(SESSION_KEY),
            "session_implementation_key": key_of((*SESSION_KEY, *PER_IMPLEMENTATION)),
        }
    )


def validate_runs(runs: DataFrame, expectation: dict[str, object], profile: dict[str, object] | None = None,
                  require_reproducible: bool = True, require_media: bool = False) -> DataFrame:
    """Run rules against one expectation; an expectation of None is skipped."""
    c = F.col
    rules: list[R.Rule] = [("status is not valid", R.differs(c("status"), F.lit("valid")))]
    named = {
        "product": "product", "workload": "workload_id", "variant": "variant",
        "benchmark contract version": "benchmark_contract_version", "run index": "run_index",
    }
    for label, column in named.items():
        if expectation.get(column) is not None:
            rules.append((f"changed {label}", R.differs(c(column), F.lit(expectation[column]))))
    if require_reproducible:
        rules.append(("not reproducible", ~R.when_present(c("reproducibility.publishable"))))
    if require_media:
        rules.append(("failed media validation", ~R.when_present(c("measured.validation.valid"))))
    if profile is not None:
        changed = F.lit(False)
        for field in PROFILE_FIELDS:
            if field in profile:
                changed = changed | R.differs(c(f"parameters.{field}").cast("string"), F.lit(profile[field]).cast("string"))
        rules.append(("changed execution profile", changed))
    return runs.withColumn("errors", R.labels(rules))


def profile_fields(runs: DataFrame) -> DataFrame:
    """Project the scheduling fields of ``parameters`` and list the missing ones."""
    missing = R.labels([(f, F.col(f"parameters.{f}").isNull()) for f in PROFILE_FIELDS])
    return runs.select("*", *[F.col(f"parameters.{f}").alias(f) for f in PROFILE_FIELDS], missing.alias("missing"))


def environment_errors(image_id: Column, revision: Column, dirty: Column) -> Column:
    """Provenance rules: image id known, revision known, source clean."""
    unknown = lambda c: R.blank(c) | (c == "unknown")
    clean = F.coalesce(F.lower(dirty).isin("0", "false"), F.lit(False))
    return R.labels([
        ("image id is unknown", unknown(image_id)),
        ("repository revision is unknown", unknown(revision)),
        ("image was built from unknown or dirty source", ~clean),
    ])


def tensor_gate(finite, exact, p99, rmse, psnr_db, limits: dict[str, float]) -> Column:
    """Errors of one tensor comparison; an exact match has infinite PSNR."""
    best = F.when(exact, F.lit(float("inf"))).otherwise(psnr_db)
    ok = R.when_present(finite)
    return R.labels([
        ("tensor contains NaN or infinity", ~ok),
        (f"p99_abs must be <= {limits['p99_abs']:g}", ok & (p99 > limits["p99_abs"])),
        (f"rmse must be <= {limits['rmse']:g}", ok & (rmse > limits["rmse"])),
        (f"psnr_db must be >= {limits['min_psnr_db']:g}", ok & (best < limits["min_psnr_db"])),
    ])


def output_gate(exact, psnr_db, ssim, limits: dict[str, float]) -> Column:
    """Errors of one decoded-output comparison; exact PSNR passes."""
    return R.labels([
        (f"psnr must be >= {limits['psnr_min_db']:g}", ~R.when_present(exact) & F.coalesce(psnr_db < limits["psnr_min_db"], F.lit(True))),
        (f"ssim must be >= {limits['ssim_min']:g}", F.coalesce(ssim < limits["ssim_min"], F.lit(True))),
    ])


# Check name -> report column of an evidence report.
REPORT_FIELDS = {
    "document type": "document_type", "status": "status", "publishable": "publishable",
    "acceptance role": "acceptance_gate", "contract version": "contract_version", "workload": "workload_id",
    "variant": "variant", "input SHA256": "input_sha256", "ONNX SHA256": "onnx_sha256",
    "execution profile": "execution_profile", "frame indices": "frame_indices",
    "reference engine": "reference_engine_sha256", "reference image": "reference_image_id",
    "reference revision": "reference_revision", "reference source state": "reference_source_dirty",
    "reference execution profile": "reference_execution_profile",
}
COMPARISON_FIELDS = {
    "status": "status", "engine": "engine_sha256", "execution profile": "execution_profile",
    "image": "image_id", "revision": "repository_revision", "source state": "source_dirty",
}


def report_identity_check(reports: DataFrame, comparisons: DataFrame, key: str) -> DataFrame:
    """Check reports (``x`` against ``expected_x``) and the candidates they must contain.

    ``reports`` carries ``expected_candidates`` (sorted array); ``comparisons`` has one row per
    report and implementation.  Report expectations of null are skipped, candidate ones are not.
    Candidates are compared by counts per report and implementation, so no list is gathered.
    """
    c = F.col
    per_candidate = R.drift(
        [(label, c(f), c(f"expected_{f}")) for label, f in COMPARISON_FIELDS.items()]
    )
    wanted = reports.select(key, F.explode("expected_candidates").alias("implementation")).distinct().withColumn("_wanted", F.lit(1))
    held = comparisons.withColumn("_wrong", per_candidate).groupBy(key, "implementation").agg(
        F.count("*").alias("_k"), F.sum(F.size("_wrong")).alias("_changes"))
    found = held.join(wanted, [key, "implementation"], "full").groupBy(key).agg(
        F.count_if(F.col("_k").isNull() | F.col("_wanted").isNull()).alias("_odd"),
        F.sum("_k").alias("_rows"), F.sum("_changes").alias("candidate_changes"),
    )
    own = [(f"changed {label}", R.differs(c(f), c(f"expected_{f}"), True)) for label, f in REPORT_FIELDS.items()]
    whole = (F.coalesce("_odd", F.lit(0)) > 0) | R.differs(c("_rows"), F.size("expected_candidates").cast("long"))
    return (
        reports.join(found, key, "left")
        .withColumn("errors", R.labels([*own, ("comparison set changed", whole)]))
        .withColumn("candidate_changes", F.coalesce("candidate_changes", F.lit(0)))
        .drop("_odd", "_rows")
    )


# Run parameter -> contract field.
CANONICAL_PARAMETERS = {
    "frames": "measured_frames", "initial_runs": "initial_runs", "extra_runs_on_spread": "extra_runs_on_spread",
    "spread_threshold": "spread_threshold", "max_relative_spread": "spread_threshold",
    "idle_seconds": "idle_seconds", "nvml_sample_interval_ms": "nvml_sample_interval_ms",
    "warmup_frames": "warmup_frames",
}


def canonical_parameter_errors(suites: DataFrame, contracts: DataFrame, key: str, warmup: bool = True) -> DataFrame:
    """Suite ``parameters`` against the contract row of its workload."""
    joined = suites.join(contracts.select(key, F.struct("*").alias("_contract")), key, "left")
    rules: list[R.Rule] = [("no canonical contract", F.col("_contract").isNull())]
    for ours, theirs in CANONICAL_PARAMETERS.items():
        if ours == "warmup_frames" and not warmup:
            continue
        changed = R.differs(F.col(f"parameters.{ours}"), F.col(f"_contract.{theirs}"))
        rules.append((f"{ours} must match {theirs}", F.col("_contract").isNotNull() & changed))
    return joined.withColumn("errors", R.labels(rules)).drop("_contract")


def eligible_media(videos: DataFrame) -> DataFrame:
    """8-bit SDR inputs; a missing transfer passes."""
    return videos.filter(F.col("pix_fmt").isin("nv12", "yuv420p") & ~sc.is_hdr(F.col("color_transfer")))


def _source_rules(name: str) -> list[R.Rule]:
    c = lambda f: F.col(f"{name}.{f}")
    return [
        (f"{name}.url must be https", ~R.when_present(c("url").startswith("https://"))),
        (f"{name}.sha256 must be lowercase sha256", ~R.lowercase_sha256(c("sha256"))),
        (f"{name}.size_bytes must be positive", ~R.positive(c("size_bytes"))),
        (f"{name}.license_reference is required", R.blank(c("license_reference"))),
        (f"{name}.attribution is required", R.blank(c("attribution"))),
    ]


def _frame_rules(label: str, indices: Column, frames: Column) -> list[R.Rule]:
    filled = R.when_present(F.size(indices) > 0)
    return [
        (f"{label} must be a non-empty integer array", ~filled),
        (f"{label} must be sorted and unique", filled & ~F.array_sort(F.array_distinct(indices)).eqNullSafe(indices)),
        (f"{label} must stay inside the clip",
         filled & ((F.array_min(indices) < 0) | (F.array_max(indices) >= frames))),
    ]


def manifest_rule_errors(workloads: DataFrame) -> DataFrame:
    """Domain rules of a workload row: benchmark, model, clip, sampling and quality sections."""
    c = F.col
    not_positive = lambda name: ~R.positive(c(name))
    fraction = lambda v: R.when_present((v >= 0) & (v < 1))
    crops = c("quality.product_output.crops")
    bad_crop = F.exists(
        crops,
        lambda k: R.blank(k["name"]) | ~R.when_present(
            (k["x"] >= 0) & (k["y"] >= 0) & (k["x"] <= 1) & (k["y"] <= 1)
            & (k["width"] > 0) & (k["height"] > 0) & (k["width"] <= 1) & (k["height"] <= 1)
        ),
    )
    outside = F.exists(crops, lambda k: (k["x"] + k["width"] > 1) | (k["y"] + k["height"] > 1))
    # Values that several rules need are computed once per row.
    held = {
        "_source": sc.rational(c("clip.temporal_sampling.source_fps")), "_target": sc.rational(c("clip.fps")),
        "_models": F.transform("model.variants", lambda v: v["name"]), "_clips": F.transform("clip.variants", lambda v: v["name"]),
        "_bad_crop": bad_crop,
    }
    source, target = c("_source"), c("_target")
    sampled = c("clip.temporal_sampling").isNotNull()
    bad_names = lambda names: F.exists(names, R.blank) | (F.size(F.array_distinct(names)) != F.size(names))
    bad_size = lambda path, *fields: F.exists(
        c(path), lambda v: ~(R.positive(v[fields[0]]) & R.positive(v[fields[1]]))
    )
    psnr_min, ssim_min = c("quality.product_output.thresholds.psnr_min_db"), c("quality.product_output.thresholds.ssim_min")
    rules: list[R.Rule] = [
        ("unsupported schema_version", R.differs(c("schema_version"), F.lit(1))),
        ("id is required", R.blank(c("id"))),
        ("lock_path must stay inside", ~R.path_contained(c("lock_path"))),
        *[(f"benchmark.{f} must be positive", not_positive(f"benchmark.{f}"))
          for f in ("contract_version", "warmup_frames", "measured_frames", "initial_runs", "nvml_sample_interval_ms")],
        ("benchmark.extra_runs_on_spread must not be negative", ~R.when_present(c("benchmark.extra_runs_on_spread") >= 0)),
        ("benchmark.spread_threshold must be in [0, 1)", ~fraction(c("benchmark.spread_threshold"))),
        ("benchmark.idle_seconds must not be negative", ~R.when_present(c("benchmark.idle_seconds") >= 0)),
        *_source_rules("model.source"),
        ("model.export_name is required", R.blank(c("model.export_name"))),
        ("model.scale must be positive", not_positive("model.scale")),
        ("model.weights_path must stay inside", ~R.path_contained(c("model.weights_path"))),
        ("model.onnx_dir must stay inside", ~R.path_contained(c("model.onnx_dir"))),
        *_source_rules("clip.source"),
        ("clip.source_path must stay inside", ~R.path_contained(c("clip.source_path"))),
        ("clip.frames must be 1000", R.differs(c("clip.frames"), F.lit(1000))),
        *_frame_rules("quality.model_space.frame_indices", c("quality.model_space.frame_indices"), c("clip.frames")),
        ("quality.model_space.contract_version must be 3", R.differs(c("quality.model_space.contract_version"), F.lit(3))),
        *[(f"quality.model_space.{f} must be positive", not_positive(f"quality.model_space.thresholds.{f}"))
          for f in ("p99_abs", "rmse", "min_psnr_db")],
        *_frame_rules("quality.product_output.frame_indices", c("quality.product_output.frame_indices"), c("clip.frames")),
        ("psnr_min_db must be positive", ~R.positive(psnr_min)),
        ("ssim_min must be in (0, 1]", ~R.when_present((ssim_min > 0) & (ssim_min <= 1))),
        ("crop is invalid", c("_bad_crop")),
        ("crop exceeds the output frame", ~c("_bad_crop") & outside),
        ("clip.fps must be positive", ~R.positive(target["num"])),
        ("temporal_sampling.source_fps must be positive", sampled & ~R.positive(source["num"])),
        ("temporal_sampling cannot raise the rate", sampled & (source["value"] < target["value"])),
        ("temporal_sampling.method must be drop", sampled & R.differs(c("clip.temporal_sampling.method"), F.lit("drop"))),
        ("temporal_sampling.round must be near", sampled & R.differs(c("clip.temporal_sampling.round"), F.lit("near"))),
        ("clip.encode.b_frames must not be negative", ~R.when_present(c("clip.encode.b_frames") >= 0)),
        ("model variant names must be unique", bad_names(c("_models"))),
        ("model variant has invalid size", bad_size("model.variants", "input_width", "input_height")),
        ("clip variant names must be unique", bad_names(c("_clips"))),
        ("clip variant has invalid size", bad_size("clip.variants", "width", "height")),
        ("clip variant has invalid bitrate", F.exists(c("clip.variants"), lambda v: ~R.positive(v["bitrate_mbps"]))),
        ("model and clip variants differ",
         R.differs(F.array_sort("_models"), F.array_sort("_clips"))),
    ]
    return workloads.withColumns(held).withColumn("errors", R.labels(rules)).drop(*held)


def resolve_parameters(df: DataFrame) -> DataFrame:
    """``override.x`` where given, else ``contract.x``; an explicit zero is kept.  Adds ``errors``."""
    fields = {
        "frames": "measured_frames", "warmup_frames": "warmup_frames", "initial_runs": "initial_runs",
        "extra_runs_on_spread": "extra_runs_on_spread", "idle_seconds": "idle_seconds",
        "spread_threshold": "spread_threshold",
    }
    pick = {ours: F.coalesce(F.col(f"override.{ours}"), F.col(f"contract.{theirs}")) for ours, theirs in fields.items()}
    pick["max_relative_spread"] = F.coalesce(
        F.col("override.max_relative_spread"), F.col("contract.spread_threshold"), F.lit(0.05)
    )
    low, high = pick["spread_threshold"], pick["max_relative_spread"]
    rules: list[R.Rule] = [
        *[(f"invalid value for {n}", ~R.when_present(pick[n] >= 0)) for n in fields],
        *[(f"{n} must be greater than zero", R.when_present(pick[n] == 0)) for n in ("frames", "warmup_frames", "initial_runs")],
        ("spread thresholds must satisfy 0 <= extension <= maximum < 1", ~R.when_present((low >= 0) & (low <= high) & (high < 1))),
    ]
    return df.withColumns({**pick, "errors": R.labels(rules)})


def resolve_profile(df: DataFrame, presets: DataFrame) -> DataFrame:
    """Preset values win and a conflicting override is an error; ``tuned`` needs every field.

    ``presets`` (implementation, execution_profile, p_requests, p_num_streams, p_threads,
    p_cuda_graph) is a fixed table of a few rows.  Overrides are text; ``auto`` means null.
    """
    c = F.col
    auto = lambda v: F.nullif(v, F.lit("auto")).try_cast("int")
    tuned = c("execution_profile") == "tuned"
    joined = df.join(presets.withColumn("_preset", F.lit(True)), ["implementation", "execution_profile"], "left")
    conflict = lambda override, value, preset: ~tuned & c("_preset").isNotNull() & c(override).isNotNull() & R.differs(value, c(preset))
    rules: list[R.Rule] = [
        ("unknown profile", ~tuned & c("_preset").isNull()),
        ("profile fixes requests", conflict("requests", auto(c("requests")), "p_requests")),
        ("profile fixes num_streams", conflict("num_streams", c("num_streams"), "p_num_streams")),
        ("profile fixes threads", conflict("threads", auto(c("threads")), "p_threads")),
        ("profile fixes cuda_graph", conflict("cuda_graph", c("cuda_graph"), "p_cuda_graph")),
        *[(f"tuned requires {n}", tuned & c(n).isNull()) for n in ("requests", "num_streams", "threads", "cuda_graph")],
    ]
    return joined.withColumns({
        "errors": R.labels(rules),
        "resolved_requests": F.when(tuned, auto(c("requests"))).otherwise(c("p_requests")),
        "resolved_num_streams": F.when(tuned, c("num_streams")).otherwise(c("p_num_streams")),
        "resolved_threads": F.when(tuned, auto(c("threads"))).otherwise(c("p_threads")),
        "resolved_cuda_graph": F.when(tuned, c("cuda_graph")).otherwise(c("p_cuda_graph")),
    }).drop("_preset", "p_requests", "p_num_streams", "p_threads", "p_cuda_graph")


def compact_candidate(df: DataFrame) -> DataFrame:
    """Narrow publication projection of candidates with renamed metrics."""
    return df.select(
        "candidate_id", "implementation", "status",
        F.col("statistics.median_fps").alias("fps_median"),
        F.col("statistics.relative_spread").alias("fps_spread"),
        F.col("statistics.median_wall_time_sec").alias("wall_sec"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    )


def engine_contract_errors(df: DataFrame) -> DataFrame:
    """Engine sidecars against the workload: static rank-4 shapes, fp32 bindings, hashes."""
    c = F.col
    static = lambda s: R.when_present((F.size(s) == 4) & F.forall(s, lambda d: R.positive(d)))
    return df.withColumn("errors", R.labels([
        ("engine hash does not match sidecar", R.differs(c("engine_sha256"), c("actual_engine_sha256"))),
        ("invalid static input shape", ~static(c("input_shape"))),
        ("invalid static output shape", ~static(c("output_shape"))),
        ("input shape does not match workload", R.differs(c("input_shape"), c("expected_input_shape"))),
        ("output shape does not match workload", R.differs(c("output_shape"), c("expected_output_shape"))),
        ("bindings must be fp32", R.differs(c("io_precision"), F.lit("fp32"))),
        ("input profile must be absent", c("input_profile").isNotNull()),
        ("engine was not built from the canonical model", R.differs(c("model_sha256"), c("expected_model_sha256"))),
    ]))


def pinned_engine_errors(df: DataFrame, version_prefix: str) -> DataFrame:
    """Further rules of engines pinned to one build environment."""
    c = F.col
    version = F.replace(c("builder_version"), F.lit("."), F.lit(""))
    return df.withColumn("errors", F.concat(c("errors"), R.labels([
        ("engine must be strongly typed", ~R.when_present(F.array_contains(c("builder_flags"), "stronglyTyped"))),
        ("engine builder version is not the pinned one", ~R.when_present(version.startswith(version_prefix))),
        ("runtime image is not the pinned one", R.differs(c("runtime_base_image"), c("expected_base_image"))),
        ("builder and runtime image differ", R.differs(c("builder_base_image"), c("runtime_base_image"))),
        ("runtime package is not the pinned one", R.differs(c("runtime_package"), c("expected_package"))),
    ])))


def upscale_shape_errors(df: DataFrame, before: str = "input_shape", after: str = "output_shape") -> DataFrame:
    """Rank 4, positive, batch 1, RGB, whole and uniform scale; later rules need the earlier ones."""
    a, b = F.col(before), F.col(after)
    at = lambda s, i: F.get(s, F.lit(i))
    rank = R.when_present((F.size(a) == 4) & (F.size(b) == 4))
    static = rank & F.forall(a, lambda d: R.positive(d)) & F.forall(b, lambda d: R.positive(d))
    batch = R.when_present((at(a, 0) == 1) & (at(b, 0) == 1))
    colour = R.when_present((at(a, 1) == 3) & (at(b, 1) == 3))
    whole = R.when_present((F.try_mod(at(b, 2), at(a, 2)) == 0) & (F.try_mod(at(b, 3), at(a, 3)) == 0))
    uniform = R.when_present(at(b, 2) * at(a, 3) == at(b, 3) * at(a, 2))
    return df.withColumns({
        "errors": R.labels([
            ("tensors must have rank 4", ~rank),
            ("shapes must be static and positive", rank & ~static),
            ("batch must be 1", static & ~batch),
            ("tensors must have 3 channels", static & ~colour),
            ("output must be a whole multiple of input", static & ~whole),
            ("scale must be uniform", static & whole & ~uniform),
        ]),
        "scale": sc.scale_of(a, b),
    })


# Fixed values of model-export evidence.
EXPORT_MAX_ABS, EXPORT_RMSE, EXPORT_MIN_PSNR = 1e-4, 1e-5, 80.0
EXPORT_CONSTANTS = {
    "document_type": "model-export-conformance", "schema_version": 2, "status": "valid",
    "export_contract": "spandrel-image-upscale-v2",
}
EXPORT_PROBE_VERSION = "rgb-coordinate-pattern-v1"


def conformance_errors(df: DataFrame) -> DataFrame:
    """Cached model-export evidence: constants, model identity, scale, thresholds and metrics."""
    c = F.col
    metrics = ("max_abs", "mean_abs", "rmse", "relative_l2", "psnr_db")
    probe = F.array(*[F.lit(v).cast("long") for v in (1, 3, 16, 16)])
    return df.withColumn("errors", R.labels([
        *[(f"field {f} is wrong", R.differs(c(f), F.lit(v))) for f, v in EXPORT_CONSTANTS.items()],
        ("source model identity does not match",
         R.differs(c("model_name"), c("expected_name")) | R.differs(c("source_sha256"), c("expected_sha256"))
         | R.differs(c("source_size_bytes"), c("expected_size_bytes"))),
        ("model scale is invalid", ~R.positive(c("scale"))),
        ("model scale is not the expected one", R.positive(c("scale")) & R.differs(c("scale"), c("expected_scale"), True)),
        ("probe version does not match", R.differs(c("probe_version"), F.lit(EXPORT_PROBE_VERSION))),
        ("probe input shape does not match", R.differs(c("probe_input_shape"), probe)),
        ("probe output shape does not match the scale", R.differs(sc.scale_of(probe, c("probe_output_shape")), c("scale").cast("long"))),
        *[(f"metric {m} is invalid", ~R.finite(c(m))) for m in metrics],
        ("error metrics cannot be negative", R.when_present(F.least(*[c(m) for m in metrics[:4]]) < 0)),
        ("max_abs exceeds its threshold", R.finite(c("max_abs")) & (c("max_abs") > EXPORT_MAX_ABS)),
        ("rmse exceeds its threshold", R.finite(c("rmse")) & (c("rmse") > EXPORT_RMSE)),
        ("psnr_db is below its threshold", R.finite(c("psnr_db")) & (c("psnr_db") < EXPORT_MIN_PSNR)),
    ]))


def timing_contract_errors(df: DataFrame) -> DataFrame:
    """CPU accounting must be described; timing scopes must add up within a millisecond."""
    c = F.col
    total = c("lifecycle.total_sec")
    scopes = c("lifecycle.startup_sec") + c("lifecycle.steady_state_frame_loop_sec") + c("lifecycle.finalize_mux_sec")
    return df.withColumn("errors", R.labels([
        ("no CPU accounting method", R.blank(c("cpu.accounting"))),
        ("no CPU accounting scope", R.blank(c("cpu.scope"))),
        ("invalid logical CPU count", ~R.positive(c("cpu.available_logical_cpus"))),
        ("invalid lifecycle timing contract", R.blank(c("lifecycle.clock")) | R.blank(c("lifecycle.boundary_contract"))),
        ("scopes do not cover wall time", ~R.when_present(F.abs(total - c("wall_time_sec")) <= 0.001)),
        ("scopes do not sum to total", ~R.when_present(F.abs(scopes - total) <= 0.001)),
    ]))


# Suite parameter -> policy field of a measuring stage.
STAGE_PARAMETERS = {
    "frames": "measured_frames", "warmup_frames": "warmup_frames", "initial_runs": "initial_runs",
    "extra_runs_on_spread": "extra_runs_on_spread", "spread_threshold": "spread_threshold",
    "max_relative_spread": "max_relative_spread", "idle_seconds": "idle_seconds",
    "bitrate_validation": "bitrate_validation",
}


def search_suite_errors(suites: DataFrame, runs: DataFrame, policies: DataFrame, key: str, stage: str) -> DataFrame:
    """Search suites against the policy of their stage and the identities of their runs.

    ``policies`` holds one row per stage (a handful).  Runs are reduced to counts per suite first.
    """
    c = F.col
    counted = runs.groupBy(key).agg(
        F.count("*").alias("_runs"), F.count_distinct("implementation_key").alias("_keys")
    )
    policy = policies.select(stage, F.struct("*").alias("_policy"))
    joined = suites.join(policy, stage, "left").join(counted, key, "left")
    changed = F.array_join(R.labels([
        (ours, R.differs(c(f"parameters.{ours}"), c(f"_policy.{theirs}"))) for ours, theirs in STAGE_PARAMETERS.items()
    ]), ", ")
    spread = c("relative_spread")
    wanted = c("_policy.initial_runs") + F.when(
        spread > c("_policy.spread_threshold"), c("_policy.extra_runs_on_spread")
    ).otherwise(0)
    return joined.withColumn("errors", R.labels([
        ("suite status is not valid", R.differs(c("status"), F.lit("valid"))),
        (F.concat(F.lit("changed stage parameters: "), changed), changed != ""),
        ("median must be positive and finite", ~R.finite_bounds(c("median_fps"))),
        ("spread must be finite and not negative", ~R.finite_bounds(spread, strict=False)),
        ("spread exceeds the limit", R.finite(spread) & (spread > c("_policy.max_relative_spread"))),
        ("run count does not match the spread policy", R.differs(F.coalesce("_runs", F.lit(0)).cast("long"), wanted.cast("long"))),
        ("runs changed immutable evidence", c("_keys") > 1),
    ])).drop("_policy", "_runs", "_keys")


# Capture scope -> stages it must contain.
SCOPE_STAGES = {
    "production-reference": ("input", "output"), "production-preprocessing": ("input",),
    "shared-input-inference": ("input", "output"),
}


def capture_errors(captures: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Tensor captures: known scope, hash lengths, canonical input, duplicates, complete set.

    Artifacts are first counted per (capture, frame, stage), so a complete set shows as equal
    counts and no list of artifacts is ever gathered.
    """
    c = F.col
    cells = artifacts.groupBy(key, "frame_index", "stage").agg(
        F.count("*").alias("_n"), F.count_if(F.length("sha256") != 64).alias("_bad")
    )
    counted = cells.groupBy(key).agg(
        F.count("*").alias("_cells"),
        F.max("_n").alias("_most"),
        F.sum("_bad").alias("_hashes"),
        F.count_distinct("frame_index").alias("_frames"),
        F.count_if(c("stage") == "input").alias("_inputs"),
        F.count_if(c("stage") == "output").alias("_outputs"),
    )
    joined = captures.join(counted, key, "left")
    scope, canonical = c("capture_scope"), c("canonical_input_manifest_sha256")
    known = F.coalesce(scope.isin(*SCOPE_STAGES), F.lit(False))
    paired = F.coalesce(scope.isin("production-reference", "shared-input-inference"), F.lit(False))
    complete = (c("_inputs") == c("_frames")) & (c("_outputs") == F.when(paired, c("_frames")).otherwise(0)) & (
        c("_cells") == c("_inputs") + c("_outputs")
    )
    shared = F.coalesce(scope == "shared-input-inference", F.lit(False))
    return joined.withColumn("errors", R.labels([
        ("implementation is required", R.blank(c("implementation"))),
        ("unknown capture scope", ~known),
        ("workload identity is required", R.blank(c("workload_id")) | R.blank(c("variant"))),
        *[(f"{n} checksum is invalid", ~R.checksum_ok(c(f"{n}_sha256"))) for n in ("input", "onnx", "engine")],
        ("no canonical input checksum", shared & ~R.checksum_ok(canonical)),
        ("only shared-input captures may name a canonical input", ~shared & canonical.isNotNull()),
        ("capture has no tensors", c("_cells").isNull()),
        ("tensor checksum is invalid", c("_hashes") > 0),
        ("duplicate tensors", c("_most") > 1),
        ("incomplete tensor set", known & ~R.when_present(complete) & c("_cells").isNotNull()),
    ])).drop("_cells", "_most", "_hashes", "_frames", "_inputs", "_outputs")
