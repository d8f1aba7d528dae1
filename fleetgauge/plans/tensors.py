"""Tensor queries: vectors 2k and 2k+1 are a reference and a candidate frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetgauge.operators import checks as ck
from fleetgauge.operators import evidence as ev
from fleetgauge.operators import joins as jn
from fleetgauge.operators import tensors as tn
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query, rounded
from fleetgauge.session import new_folder
from fleetgauge.sources.files import write_files

c = F.col
LIMITS = {"p99_abs": 0.3, "rmse": 0.16, "min_psnr_db": 16.0}

# Element rows of each pair; exact copies where the pair number is a multiple of 10.
PAIRS = """
e AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, label, embedding FROM embeddings),
pr AS (SELECT r.pair, r.label, r.embedding AS a, CASE WHEN r.pair % 10 = 0 THEN r.embedding ELSE x.embedding END AS b FROM e r JOIN e x ON r.pair = x.pair AND r.side = 0 AND x.side = 1),
el AS (SELECT pair, label, unnest(a) AS a, unnest(b) AS b FROM pr),
met AS (SELECT pair, label, count(*) AS elements, avg(abs(a - b)::DOUBLE) AS mae, sqrt(avg(pow(abs(a - b)::DOUBLE, 2))) AS rmse, quantile_cont(abs(a - b)::DOUBLE, 0.99) AS p99, max(abs(a - b)::DOUBLE) AS mx, avg(pow(abs(a - b)::DOUBLE, 2)) AS mse FROM el GROUP BY 1, 2)"""
WITH = f"WITH {PAIRS} "


def pairs(t):
    e = t.embeddings.select(F.floor(c("vec_id") / 2).cast("long").alias("pair"), (c("vec_id") % 2).alias("side"), "label", c("embedding").alias("values"))
    ref = e.filter("side = 0").select("pair", "label", c("values").alias("a"))
    cand = e.filter("side = 1").select("pair", c("values").alias("b"))
    return ref.join(cand, "pair").withColumn("b", F.when(c("pair") % 10 == 0, c("a")).otherwise(c("b")))


def compared(t):
    return pairs(t).select("pair", "label", tn.tensor_compare(c("a"), c("b")).alias("m")).select("pair", "label", "m.*")


@query("A26_tensor_compare", WITH + "SELECT pair, elements, mse = 0 AS exact, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(p99, 4) AS p99_abs, round(mx, 6) AS max_abs, round(CASE WHEN mse > 0 THEN 10 * log10(1.0 / mse) END, 4) AS psnr_db FROM met")
def _a26(t):
    out = compared(t).select("pair", "elements", "exact", *[F.round(n, 6).alias(n) for n in ("mae", "rmse", "max_abs")],
                             F.round("p99_abs", 4).alias("p99_abs"), F.round("psnr_db", 4).alias("psnr_db"))
    return out


@query("A27_tensor_summary", """WITH el AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, count(*) AS elements, true AS finite, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0 END), 9) AS below_zero_fraction,
 round(avg(CASE WHEN x > 1 THEN 1.0 ELSE 0 END), 9) AS above_one_fraction, round(avg(CASE WHEN x < 0 OR x > 1 THEN 1.0 ELSE 0 END), 9) AS outside_unit_interval_fraction FROM el GROUP BY 1""")
def _a27(t):
    out = t.embeddings.select("vec_id", tn.tensor_summary(c("embedding")).alias("m")).select("vec_id", "m.*")
    return rounded(out, 9, "below_zero_fraction", "above_one_fraction", "outside_unit_interval_fraction")


@query("A28_output_drift", WITH + """, d AS (SELECT pair, max(abs(b - a)::DOUBLE) AS mx, avg(abs(b - a)::DOUBLE) AS me, sqrt(avg(pow((b - a)::DOUBLE, 2))) AS rm, sqrt(sum(pow(a::DOUBLE, 2))) AS l, sqrt(sum(pow((b - a)::DOUBLE, 2))) AS dl FROM el GROUP BY 1)
SELECT pair, round(mx, 6) AS max_abs, round(me, 6) AS mean_abs, round(rm, 6) AS rmse, round(CASE WHEN l > 0 THEN dl / l ELSE dl END, 5) AS relative_l2, round(CASE WHEN rm = 0 THEN 200.0 ELSE 20 * log10(1.0 / rm) END, 4) AS psnr_db FROM d""")
def _a28(t):
    out = pairs(t).select("pair", tn.output_drift(c("a"), c("b")).alias("m")).select("pair", "m.*")
    return out.select("pair", *[F.round(n, 6).alias(n) for n in ("max_abs", "mean_abs", "rmse")], F.round("relative_l2", 5).alias("relative_l2"), F.round("psnr_db", 4).alias("psnr_db"))


@query("A29_quality_rollup", WITH + "SELECT label, round(max(p99), 4) AS max_p99_abs, round(max(rmse), 6) AS max_rmse, round(min(CASE WHEN mse > 0 THEN 10 * log10(1.0 / mse) END), 4) AS min_psnr_db FROM met GROUP BY 1")
def _a29(t):
    out = ev.quality_rollup(compared(t), ["label"])
    return out.select("label", F.round("max_p99_abs", 4).alias("max_p99_abs"), F.round("max_rmse", 6).alias("max_rmse"), F.round("min_psnr_db", 4).alias("min_psnr_db"))


@query("A30_preprocessing_rollup", WITH + """, s AS (SELECT pair, min(b)::DOUBLE AS lo, max(b)::DOUBLE AS hi, avg(CASE WHEN b < 0 OR b > 1 THEN 1.0 ELSE 0 END) AS out FROM el GROUP BY 1)
SELECT label, round(max(p99), 4) AS max_p99_abs, round(max(rmse), 6) AS max_rmse, round(max(out), 9) AS max_outside_fraction, min(lo) AS observed_min, max(hi) AS observed_max FROM met JOIN s USING (pair) GROUP BY 1""")
def _a30(t):
    rows = pairs(t).select("label", tn.tensor_compare(c("a"), c("b")).alias("m"), tn.tensor_summary(c("b")).alias("s"))
    flat = rows.select("label", "m.p99_abs", "m.rmse", "m.psnr_db", "s.outside_unit_interval_fraction", "s.min", "s.max")
    out = ev.preprocessing_rollup(flat, ["label"])
    return out.select("label", F.round("max_p99_abs", 4).alias("max_p99_abs"), F.round("max_rmse", 6).alias("max_rmse"),
                      F.round("max_outside_fraction", 9).alias("max_outside_fraction"), "observed_min", "observed_max")


@query("A33_set_digest", """WITH a AS (SELECT vec_id // 16 AS capture, CASE WHEN vec_id % 2 = 0 THEN 'input' ELSE 'output' END AS stage, vec_id // 2 % 8 AS i, sha256(CAST(vec_id AS VARCHAR)) AS s FROM embeddings)
SELECT capture, sha256(string_agg(stage || chr(9) || i || chr(9) || s || chr(10), '' ORDER BY stage, i, s)) AS digest, count(*) AS artifacts FROM a GROUP BY 1""")
def _a33(t):
    v = c("vec_id")
    rows = t.embeddings.select(
        F.floor(v / 16).cast("long").alias("capture"), F.when(v % 2 == 0, "input").otherwise("output").alias("stage"),
        (F.floor(v / 2) % 8).alias("frame_index"), F.sha2(v.cast("string"), 256).alias("sha256"))
    return tn.set_digest(rows, ["capture"])


# Captures of 16 vectors: 8 frames per side, alternating stage; one report per capture.
CAPTURES = """
cap AS (SELECT pair // 8 AS report_id, pair % 8 AS frame_index, CASE WHEN pair % 2 = 0 THEN 'input' ELSE 'output' END AS stage, label, pair, elements, mse, p99, rmse, pair % 10 = 0 OR pair % 2 = 0 AND pair // 8 % 3 > 0 AS same, label % 5 = 4 AS shaped, pair % 31 = 30 AS lost FROM met),
ids AS (SELECT DISTINCT report_id, report_id % 4 = 3 AS drift FROM cap),
agg AS (SELECT report_id, count(*) FILTER (NOT lost) AS tensors, count(*) FILTER (lost) AS diff, count(*) FILTER (NOT lost AND shaped) AS shapes,
  count(*) FILTER (NOT lost AND NOT shaped AND CASE WHEN stage = 'input' THEN NOT same ELSE p99 > 0.3 OR rmse > 0.16 OR (mse > 0 AND 10 * log10(1.0 / mse) < 16) END) AS bad, max(rmse) FILTER (NOT lost AND NOT shaped AND stage = 'output') AS rm FROM cap GROUP BY 1)"""


def captures(t):
    """(reference ids, candidate ids, reference tensors, candidate tensors); tensors are files of their own."""
    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, dtype="<f4").tobytes())

    folder = new_folder(t.spark, "captures")
    name = lambda number: F.concat_ws("/", F.floor(number / 64).cast("string"), F.concat(number.cast("string"), F.lit(".f32")))
    write_files(t.embeddings.select(name(c("vec_id")).alias("name"), packed("embedding").alias("content")), folder)
    e = t.embeddings.select(F.floor(c("vec_id") / 2).cast("long").alias("pair"), (c("vec_id") % 2).alias("side"), "label")
    data = e.filter("side = 0").select("pair", "label").join(e.filter("side = 1").select("pair"), "pair")
    data = data.withColumn("report_id", F.floor(c("pair") / 8).cast("long"))
    report, pair = c("report_id"), c("pair")
    # Equal hashes name the same file.
    same = (pair % 10 == 0) | ((pair % 2 == 0) & (report % 3 > 0))
    key = [report, F.when(pair % 2 == 0, "input").otherwise("output").alias("stage"), (pair % 8).alias("frame_index")]
    stored = lambda number: [F.sha2(number.cast("string"), 256).alias("sha256"), F.concat(F.lit(f"{folder}/"), name(number)).alias("path")]
    ref = data.select(*key, F.array(F.lit(3), F.lit(1)).alias("shape"), *stored(2 * pair))
    cand = data.filter(pair % 31 != 30).select(
        *key, F.lit("other").alias("implementation"), F.when(c("label") % 5 == 4, F.array(F.lit(3), F.lit(2))).otherwise(F.array(F.lit(3), F.lit(1))).alias("shape"),
        *stored(F.when(same, 2 * pair).otherwise(2 * pair + 1)))
    ids = data.select("report_id").distinct()
    shared = [F.lit("x").alias(n) for n in ("workload_id", "input_sha256", "onnx_sha256", "repository_revision", "execution_profile", "canonical_input_sha256")]
    reference = ids.select("report_id", *shared, F.lit("720p").alias("variant"))
    candidate = ids.select("report_id", F.lit("other").alias("implementation"), *shared, F.when(report % 4 == 3, "1080p").otherwise("720p").alias("variant"))
    return reference, candidate, ref, cand


@query("A49_inference_parity", WITH + f", {CAPTURES}, s AS (SELECT *, NOT drift AND diff = 0 AS clean FROM ids JOIN agg USING (report_id)) " + """
SELECT report_id, 'other' AS implementation, CASE WHEN drift THEN 'variant differs' ELSE '' END AS identity_errors, diff AS set_difference, tensors, CASE WHEN clean THEN shapes ELSE 0 END AS shape_errors, CASE WHEN clean THEN bad ELSE 0 END AS invalid_tensors,
 round(CASE WHEN clean THEN rm END, 6) AS max_rmse, CASE WHEN clean AND shapes = 0 AND bad = 0 THEN 'valid' ELSE 'invalid' END AS status FROM s""")
def _a49(t):
    out = ev.inference_parity(*captures(t), LIMITS)
    return out.select("report_id", "implementation", joined("identity_errors"), "set_difference", "tensors", "shape_errors", "invalid_tensors", F.round("max_rmse", 6).alias("max_rmse"), "status")


@query("A49b_report_status", WITH + f", {CAPTURES} " + """SELECT report_id // 4 AS session, count(*) AS candidates, count(*) FILTER (drift OR diff > 0 OR shapes > 0 OR bad > 0) AS failed, CASE WHEN count(*) FILTER (drift OR diff > 0 OR shapes > 0 OR bad > 0) = 0 THEN 'valid' ELSE 'invalid' END AS status FROM ids JOIN agg USING (report_id) GROUP BY 1""")
def _a49b(t):
    per = ev.inference_parity(*captures(t), LIMITS).withColumn("session", F.floor(c("report_id") / 4).cast("long"))
    return ev.report_status(per, "session", "valid")


@query("A50_preprocessing_diagnostic", WITH + f""", {CAPTURES}, b AS (SELECT pair, min(a)::DOUBLE AS ra, max(a)::DOUBLE AS rb, min(CASE WHEN same THEN a ELSE b END)::DOUBLE AS ca, max(CASE WHEN same THEN a ELSE b END)::DOUBLE AS cb, avg(CASE WHEN CASE WHEN same THEN a ELSE b END BETWEEN 0 AND 1 THEN 0.0 ELSE 1.0 END) AS out FROM el JOIN (SELECT pair, same FROM cap) USING (pair) GROUP BY 1),
g AS (SELECT report_id, count(*) FILTER (lost) AS diff, count(*) FILTER (NOT lost AND NOT shaped) AS tensors, max(CASE WHEN same THEN 0 ELSE rmse END) FILTER (NOT lost AND NOT shaped) AS rm, min(ra) FILTER (NOT lost AND NOT shaped) AS r0, max(rb) FILTER (NOT lost AND NOT shaped) AS r1,
 min(ca) FILTER (NOT lost AND NOT shaped) AS c0, max(cb) FILTER (NOT lost AND NOT shaped) AS c1, max(out) FILTER (NOT lost AND NOT shaped) AS o FROM cap JOIN b USING (pair) WHERE stage = 'input' GROUP BY 1)
SELECT report_id, tensors, diff AS set_difference, round(rm, 6) AS max_rmse, r0 AS reference_min, r1 AS reference_max, c0 AS candidate_min, c1 AS candidate_max, round(o, 9) AS max_outside_fraction, CASE WHEN drift OR diff > 0 THEN 'invalid' ELSE 'complete' END AS status FROM g JOIN ids USING (report_id)""")
def _a50(t):
    out = ev.preprocessing_diagnostic(*captures(t))
    return out.select("report_id", "tensors", "set_difference", F.round("max_rmse", 6).alias("max_rmse"), "reference_min", "reference_max", "candidate_min", "candidate_max",
                      F.round("max_outside_fraction", 9).alias("max_outside_fraction"), "status")


def repeat2(frame: np.ndarray) -> np.ndarray:
    """A stand-in model: every pixel twice in both directions."""
    return frame.repeat(2, axis=2).repeat(2, axis=3)


@query("Y03_score_frames", """WITH el AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, count(*) * 12 AS elements, round(sum(least(1.0, greatest(0.0, x::DOUBLE))) * 12, 4) AS total FROM el GROUP BY 1""")
def _y03(t):
    frames = t.embeddings.select("vec_id", F.concat("embedding", "embedding", "embedding").alias("values"))
    out = tn.score_frames(frames, repeat2, 8, 8, 2)
    total = F.aggregate("output", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("vec_id", F.size("output").cast("long").alias("elements"), F.round(total, 4).alias("total"))


# 8x8 NV12 frames: luma codes from the vector, chroma from its first half; then per pixel the RGB codes.
CODES = """
cd AS (SELECT vec_id, label, [greatest(16, least(235, CAST(round_even((x::DOUBLE + 0.5) * 220 + 16, 0) AS INTEGER))) FOR x IN embedding] AS code,
  label % 3 > 0 AS lim, CASE WHEN label % 2 = 0 THEN 0.2126 ELSE 0.299 END::DOUBLE AS kr, CASE WHEN label % 2 = 0 THEN 0.0722 ELSE 0.114 END::DOUBLE AS kb FROM embeddings)"""
PIXELS = CODES + """,
px AS (SELECT vec_id, lim, kr, kb, i, i // 16 * 4 + i % 8 // 2 AS k, code[i + 1]::DOUBLE AS y0, code[2 * (i // 16 * 4 + i % 8 // 2) + 1]::DOUBLE AS u0, code[2 * (i // 16 * 4 + i % 8 // 2) + 2]::DOUBLE AS v0 FROM cd, unnest(range(64)) AS r(i)),
fu AS (SELECT vec_id, lim, kr, kb, i, k, CASE WHEN lim THEN greatest(0.0, least(255.0, round_even((y0 - 16.0) * 255.0 / 219.0, 0))) ELSE y0 END AS y,
  CASE WHEN lim THEN greatest(0.0, least(255.0, round_even(u0 * (255.0::DOUBLE / 224.0) + 128.0 * (1.0 - 255.0::DOUBLE / 224.0), 0))) ELSE u0 END - 128.0 AS u,
  CASE WHEN lim THEN greatest(0.0, least(255.0, round_even(v0 * (255.0::DOUBLE / 224.0) + 128.0 * (1.0 - 255.0::DOUBLE / 224.0), 0))) ELSE v0 END - 128.0 AS v FROM px),
rb AS (SELECT *, y + 2 * (1 - kr) * v AS r0, y + 2 * (1 - kb) * u AS b0 FROM fu),
rgb AS (SELECT vec_id, lim, kr, kb, i, k, greatest(0.0, least(255.0, round_even(r0, 0))) AS r, greatest(0.0, least(255.0, round_even((y - kr * r0 - kb * b0) / (1 - kr - kb), 0))) AS g, greatest(0.0, least(255.0, round_even(b0, 0))) AS b FROM rb)"""


def codes(t):
    """8x8 NV12 frames: luma from the vector, chroma from its first half."""
    code = F.transform("embedding", lambda x: F.greatest(F.lit(16), F.least(F.lit(235), F.bround((x.cast("double") + 0.5) * 220 + 16, 0).cast("int"))))
    return t.embeddings.select(
        "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(c("label") % 2 == 0, "bt709").otherwise("bt601").alias("family"),
        (c("label") % 3 > 0).alias("limited"), F.concat(code, F.slice(code, 1, 32)).alias("codes"))


def total(column, first, size, scale):
    """Sum of a part of an array, as whole codes."""
    part = F.aggregate(F.slice(column, first, size), F.lit(0.0), lambda s, x: s + F.round(x.cast("double") * scale))
    return part.cast("long")


@query("Y04_preprocess_frames", f"""WITH {PIXELS}
SELECT vec_id, count(*) * 3 AS elements, round(min(least(r, g, b)) / 255.0, 6) AS low, round(max(greatest(r, g, b)) / 255.0, 6) AS high, sum(r)::BIGINT AS red, sum(g)::BIGINT AS green, sum(b)::BIGINT AS blue FROM rgb GROUP BY 1""")
def _y04(t):
    out = tn.preprocess_frames(codes(t), "codes")
    return out.select(
        "vec_id", F.size("rgb").cast("long").alias("elements"), F.round(F.array_min("rgb").cast("double"), 6).alias("low"), F.round(F.array_max("rgb").cast("double"), 6).alias("high"),
        *[total("rgb", 64 * n + 1, 64, 255.0).alias(name) for n, name in enumerate(("red", "green", "blue"))])


@query("Y05_postprocess_frames", f"""WITH {PIXELS},
yy AS (SELECT *, kr * r + (1 - kr - kb) * g + kb * b AS y FROM rgb),
lu AS (SELECT vec_id, sum(CASE WHEN lim THEN greatest(0.0, least(255.0, round_even(greatest(0.0, least(255.0, round_even(y, 0))) * 219.0 / 255.0 + 16.0, 0))) ELSE greatest(0.0, least(255.0, round_even(y, 0))) END)::BIGINT AS luma FROM yy GROUP BY 1),
ch AS (SELECT vec_id, lim, k, unnest([avg((b - y) / (2 * (1 - kb))), avg((r - y) / (2 * (1 - kr)))]) AS m FROM yy GROUP BY 1, 2, 3),
cc AS (SELECT vec_id, lim, greatest(0.0, least(255.0, round_even(m + 128.0, 0))) AS x FROM ch),
cs AS (SELECT vec_id, count(*) AS n, sum(CASE WHEN lim THEN greatest(0.0, least(255.0, round_even(x * (224.0::DOUBLE / 255.0) + 128.0 * (1.0 - 224.0::DOUBLE / 255.0), 0))) ELSE x END)::BIGINT AS chroma FROM cc GROUP BY 1)
SELECT vec_id, 64 + n AS elements, luma, chroma FROM lu JOIN cs USING (vec_id)""")
def _y05(t):
    out = tn.postprocess_frames(tn.preprocess_frames(codes(t), "codes"), "rgb")
    return out.select("vec_id", F.size("nv12").cast("long").alias("elements"), total("nv12", 1, 64, 1.0).alias("luma"), total("nv12", 65, 32, 1.0).alias("chroma"))


# 16x16 luma (the codes four times) and two 8x8 chroma planes; windows of 8x8 at every fourth pixel.
@query("Y06_frame_quality", f"""WITH {CODES},
pr AS (SELECT a.vec_id // 2 AS pair, a.code AS p, b.code AS q FROM cd a JOIN cd b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
el AS (SELECT pair, 'y' AS plane, i % 16 AS x, i // 16 AS y, p[i % 64 + 1]::DOUBLE AS a, q[i % 64 + 1]::DOUBLE AS b FROM pr, unnest(range(256)) AS r(i)
  UNION ALL SELECT pair, 'u', i % 8, i // 8, p[i + 1], q[i + 1] FROM pr, unnest(range(64)) AS r(i)
  UNION ALL SELECT pair, 'v', i % 8, i // 8, p[64 - i], q[64 - i] FROM pr, unnest(range(64)) AS r(i)),
w AS (SELECT pair, plane, wx, wy, sum(a) AS s1, sum(b) AS s2, sum(a * a + b * b) AS ss, sum(a * b) AS s12 FROM el, unnest(range(3)) AS v(wx), unnest(range(3)) AS u(wy)
  WHERE x // 4 IN (wx, wx + 1) AND y // 4 IN (wy, wy + 1) AND (plane = 'y' OR wx = 0 AND wy = 0) GROUP BY 1, 2, 3, 4),
sp AS (SELECT pair, plane, avg((2 * s1 * s2 + 416.0) * (2 * (s12 * 64 - s1 * s2) + 235963.0) / ((s1 * s1 + s2 * s2 + 416.0) * (ss * 64 - s1 * s1 - s2 * s2 + 235963.0))) AS s FROM w GROUP BY 1, 2),
sm AS (SELECT pair, sum(s * CASE plane WHEN 'y' THEN 256 ELSE 64 END) / 384 AS ssim FROM sp GROUP BY 1),
er AS (SELECT pair, avg((a - b) * (a - b)) AS mse FROM el GROUP BY 1)
SELECT pair, mse = 0 AS exact, round(CASE WHEN mse > 0 THEN 10 * log10(65025.0 / mse) END, 6) AS psnr_db, round(ssim, 6) AS ssim FROM er JOIN sm USING (pair)""")
def _y06(t):
    code = F.slice("codes", 1, 64)
    planes = F.concat(code, code, code, code, code, F.reverse(code))
    base = codes(t).select(F.floor(c("vec_id") / 2).cast("long").alias("pair"), (c("vec_id") % 2).alias("side"), F.lit(16).alias("height"), F.lit(16).alias("width"), planes.alias("planes"))
    ref = base.filter("side = 0").select("pair", "height", "width", c("planes").alias("ref"))
    cand = base.filter("side = 1").select("pair", c("planes").alias("cand"))
    out = tn.frame_quality(ref.join(cand, "pair"), "ref", "cand")
    return out.select("pair", "exact", F.round("psnr_db", 6).alias("psnr_db"), F.round("ssim", 6).alias("ssim"))
