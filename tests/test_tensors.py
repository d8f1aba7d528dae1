import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from fleetgauge.operators import tensors as tn
from fleetgauge.sources import readers as rd


def pair(spark, a, b):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    return df.select(tn.tensor_compare(F.col("a"), F.col("b")).alias("m"), tn.output_drift(F.col("a"), F.col("b")).alias("d"), tn.tensor_summary(F.col("b")).alias("s")).first()


def test_exact_tensors(spark):
    r = pair(spark, [0.25] * 12, [0.25] * 12)
    assert r.m.exact and r.m.psnr_db is None and r.m.rmse == 0 and r.d.psnr_db == 200.0 and r.m.elements == 12


def test_close_tensors(spark):
    a, b = np.linspace(0, 1, 12, dtype=np.float32), np.linspace(0.01, 1.1, 12, dtype=np.float32)
    r = pair(spark, a, b)
    error = np.abs(a - b)
    assert math.isclose(r.m.rmse, math.sqrt(np.mean(error.astype(np.float64) ** 2)), rel_tol=1e-12)
    assert r.m.p99_abs == float(np.percentile(error, 99)) and r.m.max_abs == float(error.max())
    assert math.isclose(r.m.psnr_db, -20 * math.log10(r.m.rmse), rel_tol=1e-9)
    assert r.s.above_one_fraction == float(np.mean(b > 1)) and r.s.below_zero_fraction == 0.0


def test_values_that_are_not_finite(spark):
    r = pair(spark, [0.0, float("nan")], [0.0, 1.0])
    assert (r.m.finite, r.m.exact, r.m.rmse) == (False, False, None) and r.s.finite


def test_set_digest_is_independent_of_order(spark):
    rows = [(c, s, i, hashlib.sha256(f"{c}{s}{i}".encode()).hexdigest()) for c in (1, 2, 3) for s in ("output", "input") for i in range(12)]
    df = spark.createDataFrame(rows, "capture int, stage string, frame_index int, sha256 string")
    expected = {c: hashlib.sha256("".join(f"{s}\t{i}\t{h}\n" for _, s, i, h in sorted(r for r in rows if r[0] == c)).encode()).hexdigest() for c in (1, 2, 3)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for frame in (df, df.repartition(7).orderBy(F.desc("sha256"))):
            got = tn.set_digest(frame, ["capture"]).collect()
            assert {r.capture: r.digest for r in got} == expected and {r.artifacts for r in got} == {24}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frame_conversion(spark):
    grey = [128] * 64 + [128] * 32
    schema = "id int, height int, width int, family string, limited boolean, codes array<int>"
    df = spark.createDataFrame([(1, 8, 8, "bt709", False, grey), (2, 8, 8, "bt601", True, [16] * 64 + [128] * 32), (3, 8, 8, "bt709", True, [235] * 64 + [128] * 32)], schema)
    rgb = tn.preprocess_frames(df, "codes")
    values = {r.id: r.rgb for r in rgb.collect()}
    assert np.allclose(values[1], 128 / 255) and np.allclose(values[2], 0.0) and np.allclose(values[3], 1.0) and len(values[1]) == 192
    back = {r.id: r.nv12 for r in tn.postprocess_frames(rgb, "rgb").collect()}
    assert back[1] == grey and back[2] == [16] * 64 + [128] * 32 and back[3] == [235] * 64 + [128] * 32


def test_frame_quality(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 16 * 16 * 3 // 2)
    b = np.clip(a + rng.integers(-9, 10, a.size), 0, 255)
    rows = [(1, 16, 16, a.tolist(), a.tolist()), (2, 16, 16, a.tolist(), b.tolist())]
    out = {r.id: r for r in tn.frame_quality(spark.createDataFrame(rows, "id int, height int, width int, r array<int>, c array<int>"), "r", "c").collect()}
    assert out[1].exact and out[1].psnr_db is None and math.isclose(out[1].ssim, 1.0)
    assert math.isclose(out[2].psnr_db, 10 * math.log10(255**2 / np.mean((a - b) ** 2))) and 0.5 < out[2].ssim < 1


def test_model_contract_is_checked(spark):
    df = spark.createDataFrame([(1, [0.5] * 12)], "id int, values array<float>")
    good = tn.score_frames(df, lambda x: x.repeat(2, axis=2).repeat(2, axis=3) * 3, 2, 2, 2).first()
    assert len(good.output) == 48 and set(good.output) == {1.0}
    try:
        tn.score_frames(df, lambda x: x, 2, 2, 2).collect()
    except Exception as exc:
        assert "the contract says" in str(exc)
    else:
        raise AssertionError("a broken model was accepted")


def test_tensor_files(spark, tmp_path):
    values = np.arange(12, dtype="<f4") / 7
    (tmp_path / "good.f32").write_bytes(values.tobytes())
    (tmp_path / "short.f32").write_bytes(values[:5].tobytes())
    (tmp_path / "none.f32").write_bytes(b"")
    out = {r.path.rsplit("/", 1)[1]: r for r in rd.read_frame_tensors(spark, f"{tmp_path}/*.f32", F.lit(12)).collect()}
    assert np.array_equal(np.array(out["good.f32"]["values"], dtype="<f4"), values) and out["good.f32"].size_error is None
    assert all(out[n]["values"] is None and out[n].size_error for n in ("short.f32", "none.f32")) and out["none.f32"].length == 0


def test_tensor_files_are_compared_by_path(spark, tmp_path):
    a, b = np.linspace(-0.5, 1, 12, dtype="<f4"), np.linspace(0, 1.5, 12, dtype="<f4")
    for name, content in (("a", a.tobytes()), ("b", b.tobytes()), ("short", a[:5].tobytes()), ("odd", b"123"), ("nan", np.array([np.nan] * 12, "<f4").tobytes())):
        (tmp_path / name).write_bytes(content)
    pairs = [("a", "b", False), ("a", "gone", True), ("a", "short", False), ("a", "odd", False), ("a", "gone", False), ("nan", "nan", True), (None, "a", False)]
    df = spark.createDataFrame([(n, f"{tmp_path}/{x}" if x else None, f"{tmp_path}/{y}", e) for n, (x, y, e) in enumerate(pairs)], "k int, x string, y string, e boolean")
    rows = {r.k: r.m for r in df.select("k", tn.compare_tensor_files(F.col("x"), F.col("y"), F.col("e")).alias("m")).collect()}
    whole = pair(spark, a, b)
    assert (rows[0].rmse, rows[0].p99_abs, rows[0].exact, rows[0].sizes_differ) == (whole.m.rmse, whole.m.p99_abs, False, False)
    assert (rows[0].candidate_min, rows[0].candidate_max, rows[0].candidate_outside) == (whole.s.min, whole.s.max, whole.s.outside_unit_interval_fraction)
    # Equal by hash: only the reference is loaded.
    assert rows[1].exact and rows[1].candidate_max == 1.0 and rows[1].read_error is None
    assert rows[2].sizes_differ and rows[2].rmse is None
    assert rows[3].read_error and rows[4].read_error and rows[5].finite is False and rows[6].elements is None


def test_no_values_travel(spark, tmp_path):
    from fleetgauge.operators import evidence as ev
    from fleetgauge.plans.registry import Tables
    from fleetgauge.plans.tensors import LIMITS, captures

    found = captures(Tables(spark, "/root/testdata/sf0.001"))
    for df in (ev.inference_parity(*found, LIMITS), ev.preprocessing_diagnostic(*found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "array<float>" not in plan
        for table in found[2:]:
            assert not any(kind == "array<float>" for _, kind in table.dtypes)


def test_metrics_of_unequal_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0]), (2, [], []), (3, None, [1.0]), (4, [0.5, 2.0], [0.5, 2.0]), (5, [float("nan")], [1.0])], "k int, a array<float>, b array<float>")
    rows = {r.k: r for r in df.select("k", tn.tensor_compare(F.col("a"), F.col("b")).alias("m"), tn.output_drift(F.col("a"), F.col("b")).alias("d"), tn.tensor_summary(F.col("a")).alias("s")).collect()}
    for k in (1, 2, 3):
        assert rows[k].m.exact is False and rows[k].m.rmse is None and rows[k].d.rmse is None
    assert rows[4].m.exact and rows[4].d.psnr_db == 200.0
    assert (rows[2].s.elements, rows[2].s.min) == (0, None) and rows[5].s.finite is False and rows[5].s.max is None
    assert (rows[4].s.min, rows[4].s.max, rows[4].s.above_one_fraction) == (0.5, 2.0, 0.5)
