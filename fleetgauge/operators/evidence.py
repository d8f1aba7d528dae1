"""Quality rollups, parity reports and published result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.operators import checks as ck
from fleetgauge.operators.joins import missing_and_unexpected, pair_frames
from fleetgauge.operators.tensors import compare_tensor_files


def quality_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst tensor metrics per implementation; nulls (exact matches) are ignored."""
    return df.groupBy(*keys).agg(
        F.max("p99_abs").alias("max_p99_abs"), F.max("rmse").alias("max_rmse"), F.min("psnr_db").alias("min_psnr_db"))


def preprocessing_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``quality_rollup``, with the range of candidate values."""
    return df.groupBy(*keys).agg(
        F.max("p99_abs").alias("max_p99_abs"), F.max("rmse").alias("max_rmse"), F.min("psnr_db").alias("min_psnr_db"),
        F.max("outside_unit_interval_fraction").alias("max_outside_fraction"),
        F.min("min").alias("observed_min"), F.max("max").alias("observed_max"),
    )


def product_rollup(psnr: DataFrame, ssim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSNR, SSIM and compared frames per candidate from the two metric tables."""
    left = psnr.select(*keys, "exact", "average_db", F.col("frames").alias("psnr_frames"))
    right = ssim.select(*keys, F.col("all").alias("ssim"), F.col("frames").alias("ssim_frames"))
    return left.join(right, list(keys), "full")


def session_observations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest temperature, any power cap and the distinct clock reasons over the rounds.

    Reason lists come from a nine-name vocabulary, which bounds the distinct-list buffer.
    """
    return df.groupBy(*keys).agg(
        F.max("peak_c").alias("peak_temperature_c"), F.bool_or("power_cap_observed").alias("power_cap_observed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("throttle_reasons")))).alias("throttle_reasons"),
    )


def provenance_flags(df: DataFrame, group: Sequence[str], workload: Sequence[str], hashes: Sequence[str], expected: int) -> DataFrame:
    """Whether in every workload of the group each hash differs across the implementations."""
    inner = df.groupBy(*group, *workload).agg(*[(F.count_distinct(h) == expected).alias(h) for h in hashes])
    return inner.groupBy(*group).agg(*[F.bool_and(h).alias(f"{h}_differ") for h in hashes])


IDENTITY = {
    "workload": "workload_id", "variant": "variant", "input SHA256": "input_sha256", "ONNX SHA256": "onnx_sha256",
    "repository revision": "repository_revision", "execution profile": "execution_profile",
}


def _identity(reference: DataFrame, candidates: DataFrame, report: str, extra: dict[str, str]) -> DataFrame:
    fields = {**IDENTITY, **extra}
    held = reference.select(report, F.struct(*[n for n in reference.columns if n != report]).alias("_r"))
    joined = candidates.join(held, report)
    pairs = [(label, F.col(f), F.col(f"_r.{f}")) for label, f in fields.items()]
    return joined.withColumn(
        "identity_errors", F.transform(R.drift(pairs), lambda e: F.concat(e, F.lit(" differs")))
    ).select(report, "implementation", "identity_errors")


def _set_difference(ref: DataFrame, cand: DataFrame, candidates: DataFrame, report: str) -> DataFrame:
    """Number of (stage, frame) keys on one side only, per candidate."""
    wanted = candidates.select(report, "implementation").join(ref.select(report, "stage", "frame_index"), report)
    keys = [report, "implementation", "stage", "frame_index"]
    wrong = missing_and_unexpected(cand, wanted, keys)
    return wrong.groupBy(report, "implementation").agg(F.count("*").alias("set_difference"))


def _paired(ref: DataFrame, cand: DataFrame, report: str) -> DataFrame:
    return pair_frames(ref, cand, [report, "stage", "frame_index"])


def inference_parity(reference: DataFrame, candidates: DataFrame, ref_tensors: DataFrame, cand_tensors: DataFrame,
                     limits: dict[str, float], report: str = "report_id") -> DataFrame:
    """One row per candidate: identity drift, tensor set, input hashes and the output gate.

    Tensors: report, stage, frame_index, shape, sha256, path; candidate tensors also carry
    implementation.  Inputs must be hash-equal and are never loaded; outputs are loaded by path
    after pairing and must pass the gate.  Outputs of different shape or size are shape errors
    and are not judged; a file that cannot be read fails the gate.
    """
    c = F.col
    pairs = _paired(ref_tensors, cand_tensors, report)
    same = c("r.sha256").eqNullSafe(c("c.sha256"))
    wanted = lambda side: F.when((c("stage") != "input") & ~c("shape_differs"), c(f"{side}.path"))
    scored = pairs.withColumn("m", compare_tensor_files(wanted("r"), wanted("c"), same))
    scored = scored.withColumn("shape_differs", c("shape_differs") | F.coalesce(c("m.sizes_differ"), F.lit(False)))
    gate = ck.tensor_gate(c("m.finite"), c("m.exact"), c("m.p99_abs"), c("m.rmse"), c("m.psnr_db"), limits)
    bad = F.when(c("stage") == "input", ~same).otherwise(F.size(gate) > 0)
    per = scored.withColumn("_bad", bad).groupBy(report, c("c.implementation").alias("implementation")).agg(
        F.count("*").alias("tensors"), F.count_if("shape_differs").alias("shape_errors"),
        F.count_if(~c("shape_differs") & c("_bad")).alias("invalid_tensors"),
        F.max(F.when(c("stage") == "output", c("m.rmse"))).alias("max_rmse"),
    )
    keys = [report, "implementation"]
    joined = _identity(reference, candidates, report, {"canonical input manifest SHA256": "canonical_input_sha256"}).join(
        _set_difference(ref_tensors, cand_tensors, candidates, report), keys, "left").join(per, keys, "left")
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("set_difference", "tensors", "shape_errors", "invalid_tensors")}
    clean = (F.size("identity_errors") == 0) & (c("set_difference") == 0)
    # Tensors of a candidate whose identity differs are not compared.
    return joined.withColumns(counts).withColumns({
        "invalid_tensors": F.when(clean, c("invalid_tensors")).otherwise(0),
        "shape_errors": F.when(clean, c("shape_errors")).otherwise(0),
        "max_rmse": F.when(clean, c("max_rmse")),
    }).withColumn("status", F.when(clean & (c("invalid_tensors") == 0) & (c("shape_errors") == 0), "valid").otherwise("invalid"))


def preprocessing_diagnostic(reference: DataFrame, candidates: DataFrame, ref_tensors: DataFrame, cand_tensors: DataFrame,
                             report: str = "report_id") -> DataFrame:
    """Input tensors only, with range facts of both sides; values never gate, identity does.

    Tensors: report, stage, frame_index, shape, sha256, path.  Pairs are loaded by path, those of equal hash once.
    """
    c = F.col
    inputs = lambda df: df.filter(c("stage") == "input")
    pairs = _paired(inputs(ref_tensors), inputs(cand_tensors), report).filter(~c("shape_differs"))
    loaded = compare_tensor_files(c("r.path"), c("c.path"), c("r.sha256").eqNullSafe(c("c.sha256")))
    facts = pairs.select(report, c("c.implementation").alias("implementation"), loaded.alias("m"))
    per = facts.groupBy(report, "implementation").agg(
        F.count("*").alias("tensors"), F.max("m.p99_abs").alias("max_p99_abs"), F.max("m.rmse").alias("max_rmse"),
        F.min("m.reference_min").alias("reference_min"), F.max("m.reference_max").alias("reference_max"),
        F.min("m.candidate_min").alias("candidate_min"), F.max("m.candidate_max").alias("candidate_max"),
        F.max("m.candidate_outside").alias("max_outside_fraction"),
    )
    keys = [report, "implementation"]
    joined = _identity(reference, candidates, report, {}).join(
        _set_difference(inputs(ref_tensors), inputs(cand_tensors), candidates, report), keys, "left").join(per, keys, "left")
    ok = (F.size("identity_errors") == 0) & F.col("set_difference").isNull()
    return joined.withColumns({
        "tensors": F.coalesce("tensors", F.lit(0)), "set_difference": F.coalesce("set_difference", F.lit(0)),
        "status": F.when(ok, "complete").otherwise("invalid"),
    })


def report_status(per_candidate: DataFrame, report: str, good: str) -> DataFrame:
    """Overall status of a report: good when all its candidates are."""
    return per_candidate.groupBy(report).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("status") != good).alias("failed")
    ).withColumn("status", F.when(F.col("failed") == 0, good).otherwise("invalid"))


def output_parity(evidence: DataFrame, psnr: DataFrame, ssim: DataFrame, keys: Sequence[str], report: str,
                  expected_frames: Column, limits: dict[str, float]) -> DataFrame:
    """One row per candidate from the two metric tables, judged by the output gate.

    ``evidence`` is the result of ``joins.evidence_set_errors`` (report, changes, errors).
    """
    c = F.col
    metrics = product_rollup(psnr, ssim, keys)
    frames_ok = c("psnr_frames").eqNullSafe(expected_frames) & c("ssim_frames").eqNullSafe(expected_frames)
    gate = ck.output_gate(c("exact"), c("average_db"), c("ssim"), limits)
    joined = metrics.join(evidence.select(report, "changes", c("errors").alias("_set")), report)
    errors = F.concat(
        c("_set"), R.labels([("candidates changed the contract", c("changes") > 0), ("compared frames differ from expected frames", ~frames_ok)]), gate)
    return joined.select(
        *keys, "exact", c("average_db").alias("psnr_db"), "ssim", errors.alias("errors"),
        F.when(F.size(errors) == 0, "valid").otherwise("invalid").alias("status"))


def published_results(campaigns: DataFrame, winners: DataFrame, quality: DataFrame, identity: DataFrame,
                      required: DataFrame, keys: Sequence[str] = ("workload_id", "variant")) -> DataFrame:
    """Published rows per (workload, variant, implementation) and what blocks a workload.

    campaigns: keys, implementation, median_fps, status.  winners: keys, implementation,
    confirmation_fps.  quality: keys, implementation, max_rmse, min_psnr_db.  identity: keys,
    tensors_identical, outputs_identical.  Required workloads that are absent become rows too.
    """
    c = F.col
    k, ki = list(keys), [*keys, "implementation"]
    wanted = required.select(*k).distinct().withColumn("_wanted", F.lit(True))
    rows = campaigns.join(winners, ki, "left").join(quality, ki, "left").join(identity, k, "left")
    both = wanted.join(rows.withColumn("_have", F.lit(True)), k, "full")
    have = c("_have").isNotNull()
    return both.select(
        *ki, "median_fps", "confirmation_fps", ((c("median_fps") / c("confirmation_fps") - 1.0) * 100.0).alias("delta_percent"),
        "max_rmse", "min_psnr_db", "tensors_identical", "outputs_identical",
        R.labels([
            ("required workload is missing", ~have),
            ("workload is not part of the matrix", have & c("_wanted").isNull()),
            ("campaign is not valid", have & R.differs(c("status"), F.lit("valid"))),
            ("no output identity", have & c("outputs_identical").isNull()),
        ]).alias("errors"),
    )


def published_diagnostics(suites: DataFrame, runs: DataFrame, key: str, constants: Sequence[str]) -> DataFrame:
    """Inference-only suites: valid, clean, and constant over their runs, with observations.

    ``runs``: key, status, source_dirty, the ``constants`` columns, peak_c, power_cap_observed,
    throttle_reasons.  Constancy is min = max of a hash, which combines map-side.
    """
    c = F.col
    hashed = runs.withColumns({f"_h_{n}": F.sha2(F.to_json(F.struct(n), {"ignoreNullFields": "false"}), 256) for n in constants})
    facts = hashed.groupBy(key).agg(
        F.count("*").alias("runs"), F.bool_and(c("status") == "valid").alias("_valid"),
        F.bool_and(F.coalesce(c("source_dirty").isin("0", "false"), F.lit(False))).alias("_clean"),
        *[(F.min(f"_h_{n}") == F.max(f"_h_{n}")).alias(f"_same_{n}") for n in constants],
    )
    seen = session_observations(runs, [key])
    joined = suites.join(facts, key, "left").join(seen, key, "left")
    have = c("runs").isNotNull()
    return joined.withColumn("errors", R.labels([
        ("invalid suite", R.differs(c("status"), F.lit("valid"))),
        ("unpublishable suite", ~R.when_present(c("publishable"))),
        ("suite has no runs", ~have),
        ("invalid run", have & ~R.when_present(c("_valid"))),
        ("dirty run source", have & ~R.when_present(c("_clean"))),
        *[(f"run {n} drift", have & ~R.when_present(c(f"_same_{n}"))) for n in constants],
    ])).drop("_valid", "_clean", *[f"_same_{n}" for n in constants])
