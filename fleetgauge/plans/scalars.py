"""Scalar function queries over whole part, orders, customer, events and embeddings tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import scalars as sc
from fleetgauge.plans.registry import query

RATE_SQL = """CASE p_partkey % 6 WHEN 0 THEN '30000/1001' WHEN 1 THEN p_size || '/1' WHEN 2 THEN CAST(p_size AS VARCHAR)
 WHEN 3 THEN (p_size * 1000) || '/1001' WHEN 4 THEN p_size || '/0' ELSE (2 * p_size + 1) || '/2' END"""


def rate():
    size = F.col("p_size").cast("string")
    slot = F.col("p_partkey") % 6
    return (
        F.when(slot == 0, "30000/1001")
        .when(slot == 1, F.concat(size, F.lit("/1")))
        .when(slot == 2, size)
        .when(slot == 3, F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001")))
        .when(slot == 4, F.concat(size, F.lit("/0")))
        .otherwise(F.concat((2 * F.col("p_size") + 1).cast("string"), F.lit("/2")))
    )


NUM_SQL = """CASE p_partkey % 6 WHEN 0 THEN 30000 WHEN 1 THEN p_size WHEN 2 THEN p_size WHEN 3 THEN p_size * 1000
 WHEN 4 THEN 0 ELSE 2 * p_size + 1 END"""
DEN_SQL = "CASE p_partkey % 6 WHEN 0 THEN 1001 WHEN 3 THEN 1001 WHEN 5 THEN 2 ELSE 1 END"
BASE = f"WITH r AS (SELECT *, {NUM_SQL} AS num, {DEN_SQL} AS den FROM part) "


@query("F01_parse_rational", BASE + "SELECT p_partkey, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, round(num / den, 9) AS value FROM r")
def _f01(t):
    r = sc.rational(rate())
    return t.part.select("p_partkey", r["num"].alias("num"), r["den"].alias("den"), F.round(r["value"], 9).alias("value"))


@query("F02_rational_equal", BASE + "SELECT p_partkey, num * 1001 = 24000 * den OR num = p_size AND den = 1 AS same FROM r")
def _f02(t):
    film = sc.rational_equal(rate(), F.lit("24000/1001"))
    plain = sc.rational_equal(rate(), F.concat((F.col("p_size") * 3).cast("string"), F.lit("/3")))
    return t.part.select("p_partkey", (film | plain).alias("same"))


@query("F03_gop_frames", BASE + "SELECT p_partkey, CASE WHEN num > 0 THEN CAST(greatest(1, floor((2 * num + den) / (2 * den))) AS BIGINT) END AS gop FROM r")
def _f03(t):
    return t.part.select("p_partkey", sc.gop_frames(rate()).alias("gop"))


@query("F04_gop_frames_contract", BASE + "SELECT p_partkey, CASE WHEN num > 0 THEN CAST(greatest(1, round_even(num / den, 0)) AS BIGINT) END AS gop FROM r")
def _f04(t):
    return t.part.select("p_partkey", sc.gop_frames_contract(rate()).alias("gop"))


@query("F05_auto_bitrate", """
WITH r AS (SELECT p_partkey, CAST(round(p_retailprice * 1000) AS BIGINT) AS src, (p_partkey % 7) * 320 AS w, p_size * 20 AS h,
  2560 AS ow, 1440 AS oh, CAST(p_partkey % 4 AS DOUBLE) * 12.0 AS fi, 24.0 AS fo FROM part),
q AS (SELECT *, CASE WHEN w * h > 0 THEN (ow * oh) / (w * h) ELSE 1.0 END AS pr,
  CASE WHEN fi > 0 AND fo > 0 THEN fo / fi ELSE 1.0 END AS fr FROM r)
SELECT p_partkey, CAST(floor(src * pow(pr * fr, 0.6)) AS BIGINT) AS bitrate, round(pr, 9) AS pixel_ratio, round(fr, 9) AS fps_ratio FROM q""")
def _f05(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    found = sc.auto_bitrate(
        F.round(F.col("p_retailprice") * 1000).cast("long"), (key % 7) * 320, size * 20,
        F.lit(2560), F.lit(1440), (key % 4).cast("double") * 12.0, F.lit(24.0),
    )
    return t.part.select(
        "p_partkey", found["bitrate"].alias("bitrate"),
        F.round(found["pixel_ratio"], 9).alias("pixel_ratio"), F.round(found["fps_ratio"], 9).alias("fps_ratio"),
    )


@query("F06_resolve_bitrate", """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS m,
  CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN p_size * 1000 END AS s,
  CASE WHEN p_partkey % 2 = 0 THEN p_size * 900 ELSE 0 END AS c FROM part)
SELECT p_partkey, CAST(coalesce(m * 1000000, nullif(s, 0), nullif(c, 0)) AS BIGINT) AS bitrate,
 CASE WHEN m IS NOT NULL THEN 'manual' WHEN nullif(s, 0) IS NOT NULL THEN 'video stream'
  WHEN nullif(c, 0) IS NOT NULL THEN 'container' ELSE 'missing' END AS source FROM r""")
def _f06(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    found = sc.resolve_bitrate(
        F.when(key % 5 == 0, size),
        F.when(key % 3 == 0, 0).when(key % 3 == 1, size * 1000).cast("long"),
        F.when(key % 2 == 0, size * 900).otherwise(0).cast("long"),
    )
    return t.part.select("p_partkey", found["bitrate"].alias("bitrate"), found["source"].alias("source"))


@query("F07_optional_int", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN p_name
 WHEN 3 THEN CAST(-p_size AS VARCHAR) WHEN 4 THEN CAST(p_size - 1 AS VARCHAR) END AS v FROM part)
SELECT p_partkey, CASE WHEN TRY_CAST(v AS BIGINT) > 0 THEN TRY_CAST(v AS BIGINT) END AS value FROM r""")
def _f07(t):
    slot, size = F.col("p_partkey") % 6, F.col("p_size")
    text = (
        F.when(slot == 0, "").when(slot == 1, "N/A").when(slot == 2, F.col("p_name"))
        .when(slot == 3, (-size).cast("string")).when(slot == 4, (size - 1).cast("string"))
    )
    return t.part.select("p_partkey", sc.optional_int(text).alias("value"))


def probe_json():
    """A probe document per part: an audio stream, then usually a video stream."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    video = F.format_string(
        '{"codec_type":"video","width":%d,"height":"%d","r_frame_rate":"%s/1","nb_frames":"%d","pix_fmt":"nv12","bit_rate":"%s"}',
        F.col("p_size") * 16, F.col("p_size") * 9, size, key, F.when(key % 3 == 0, "N/A").otherwise(size),
    )
    streams = F.concat(
        F.lit('[{"codec_type":"audio"}'),
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit(","), video)), F.lit("]"),
    )
    return F.concat(F.lit('{"streams":'), streams, F.lit(',"format":{"bit_rate":"'), size, F.lit('00"}}'))


@query("F08_normalise_video", """
WITH r AS (SELECT *, p_partkey % 11 <> 0 AS v FROM part)
SELECT p_partkey, CASE WHEN v THEN CAST(p_size * 16 AS BIGINT) END AS width, CASE WHEN v THEN CAST(p_size * 9 AS BIGINT) END AS height,
 CASE WHEN v THEN CAST(p_size AS DOUBLE) END AS fps, CASE WHEN v THEN p_size || '/1' END AS fps_text,
 CASE WHEN v THEN p_partkey END AS frames, CASE WHEN v THEN 'nv12' END AS pix_fmt, CAST(NULL AS VARCHAR) AS color_space,
 CASE WHEN v AND p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS video_bit_rate,
 CASE WHEN v THEN CAST(p_size AS BIGINT) * 100 END AS container_bit_rate FROM r""")
def _f08(t):
    df = t.part.select("p_partkey", sc.normalise_video(probe_json()).alias("v"))
    return df.select("p_partkey", *[F.col(f"v.{n}").alias(n) for n in (
        "width", "height", "fps", "fps_text", "frames", "pix_fmt", "color_space", "video_bit_rate", "container_bit_rate")])


@query("F09_colour_defaults", """
WITH r AS (SELECT p_partkey, p_size * 40 AS w, p_size * 20 AS h, CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'pc' WHEN 2 THEN '' END AS c FROM part),
q AS (SELECT *, CASE WHEN w >= 1280 OR h >= 720 THEN 'bt709' ELSE 'smpte170m' END AS d FROM r)
SELECT p_partkey, CASE WHEN c = 'pc' THEN 'pc' ELSE 'tv' END AS color_range, CASE WHEN c = 'pc' THEN 'pc' ELSE d END AS color_space,
 d AS color_transfer, 'bt2020' AS color_primaries FROM q""")
def _f09(t):
    slot, size = F.col("p_partkey") % 4, F.col("p_size")
    given = F.when(slot == 0, "unknown").when(slot == 1, "pc").when(slot == 2, "")
    c = sc.colour_defaults(size * 40, size * 20, given, given, F.lit("reserved"), F.lit("bt2020"))
    return t.part.select("p_partkey", *[c[n].alias(n) for n in ("color_range", "color_space", "color_transfer", "color_primaries")])


@query("F10_colour_family", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'bt2020nc' WHEN 1 THEN 'bt2020c' WHEN 2 THEN 'smpte170m' WHEN 3 THEN 'bt470bg'
 WHEN 4 THEN 'bt470m' WHEN 5 THEN p_type END AS s FROM part)
SELECT p_partkey, CASE WHEN s IN ('bt2020nc', 'bt2020c') THEN 'bt2020' WHEN s IN ('smpte170m', 'bt470bg', 'bt470m') THEN 'bt601' ELSE 'bt709' END AS family FROM r""")
def _f10(t):
    slot = F.col("p_partkey") % 7
    space = F.when(slot == 0, "bt2020nc").when(slot == 1, "bt2020c").when(slot == 2, "smpte170m").when(
        slot == 3, "bt470bg").when(slot == 4, "bt470m").when(slot == 5, F.col("p_type"))
    return t.part.select("p_partkey", sc.colour_family(space).alias("family"))


@query("F11_crop_rectangle", """
WITH r AS (SELECT p_partkey, (p_partkey % 9) / 8.0 AS x, (p_partkey % 5) / 4.0 AS y, p_size / 50.0 AS w, (p_partkey % 3) / 512.0 AS h,
  p_size * 13 AS ow, p_size * 7 AS oh FROM part),
q AS (SELECT *, CAST(greatest(1, round_even(ow * w, 0)) AS BIGINT) AS width, CAST(greatest(1, round_even(oh * h, 0)) AS BIGINT) AS height FROM r)
SELECT p_partkey, least(CAST(round_even(ow * x, 0) AS BIGINT), ow - width) AS x, least(CAST(round_even(oh * y, 0) AS BIGINT), oh - height) AS y, width, height FROM q""")
def _f11(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    c = sc.crop_rectangle((key % 9) / 8.0, (key % 5) / 4.0, size / 50.0, (key % 3) / 512.0, size * 13, size * 7)
    return t.part.select("p_partkey", *[c[n].alias(n) for n in ("x", "y", "width", "height")])


@query("F12_is_dynamic", "SELECT p_partkey, p_partkey % 4 = 0 OR p_size - 3 <= 0 AS dynamic FROM part")
def _f12(t):
    dims = F.array(
        F.lit("1"), F.when(F.col("p_partkey") % 4 == 0, "batch").otherwise("3"), (F.col("p_size") - 3).cast("string")
    )
    return t.part.select("p_partkey", sc.is_dynamic(dims).alias("dynamic"))


SHAPES = """WITH r AS (SELECT p_partkey, p_size AS a2, p_size + p_partkey % 2 AS a3, p_size * (1 + p_partkey % 3) + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS b2,
  (p_size + p_partkey % 2) * (1 + p_partkey % 5) AS b3, CASE WHEN p_partkey % 13 = 0 THEN 4 ELSE 3 END AS ch FROM part) """


def shapes():
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    before = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"), size, size + key % 2)
    after = F.array(
        F.lit(1).cast("long"), F.when(key % 13 == 0, 4).otherwise(3).cast("long"),
        size * (1 + key % 3) + F.when(key % 17 == 0, 1).otherwise(0), (size + key % 2) * (1 + key % 5),
    )
    return before, after


@query("F13_scale_of", SHAPES + """SELECT p_partkey, CASE WHEN ch = 3 AND a2 > 0 AND a3 > 0 AND b2 % a2 = 0 AND b3 % a3 = 0 AND b2 // a2 = b3 // a3
 THEN CAST(b2 // a2 AS BIGINT) END AS scale FROM r""")
def _f13(t):
    before, after = shapes()
    return t.part.select("p_partkey", sc.scale_of(before, after).alias("scale"))


@query("F14_psnr", """SELECT o_orderkey, round(CASE WHEN o_custkey % 10 > 0 THEN 10 * log10(1.0 / ((o_custkey % 10) / o_totalprice)) END, 6) AS psnr_db,
 round(CASE WHEN o_custkey % 10 = 0 THEN 200.0 ELSE 20 * log10(1.0 / ((o_custkey % 10) / o_totalprice)) END, 6) AS psnr_rmse_db FROM orders""")
def _f14(t):
    error = (F.col("o_custkey") % 10) / F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.round(sc.psnr(error), 6).alias("psnr_db"), F.round(sc.psnr_rmse(error), 6).alias("psnr_rmse_db")
    )


@query("F15_candidate_id", """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE replace(lower(p_brand), '#', '-') END AS i, p_size, p_partkey % 3 = 0 AS a, p_partkey % 5 = 0 AS g FROM part),
q AS (SELECT p_partkey, i || '-s' || p_size || CASE WHEN a THEN '-tauto' ELSE '' END || '-g' || CAST(g AS INTEGER) AS c FROM r)
SELECT p_partkey, CASE WHEN regexp_matches(c, '^[a-z0-9][a-z0-9-]*$') THEN c END AS candidate_id FROM q""")
def _f15(t):
    key, brand = F.col("p_partkey"), F.lower("p_brand")
    name = F.when(key % 2 == 0, brand).otherwise(F.replace(brand, F.lit("#"), F.lit("-")))
    return t.part.select("p_partkey", sc.candidate_id(name, F.col("p_size"), key % 3 == 0, key % 5 == 0).alias("candidate_id"))


@query("F16_duration_matches", """SELECT o_orderkey, abs(o_totalprice / 1000 - (o_custkey % 5000) / 24.0) <= 1.0 / 24.0 + 1e-6 AS ok FROM orders""")
def _f16(t):
    return t.orders.select(
        "o_orderkey", sc.duration_matches(F.col("o_totalprice") / 1000, F.col("o_custkey") % 5000, F.lit(24.0)).alias("ok")
    )


@query("F17_bitrate_delta", """SELECT o_orderkey, round(abs(o_totalprice - 150000.0) / 150000.0, 9) AS delta,
 coalesce(abs(nullif(o_totalprice, 0) - 150000.0) / 150000.0 <= 0.1, false) AS ok FROM orders""")
def _f17(t):
    actual, target = F.col("o_totalprice"), F.lit(150000.0)
    return t.orders.select(
        "o_orderkey", F.round(sc.bitrate_delta(actual, target), 9).alias("delta"),
        sc.bitrate_matches(actual, target, F.lit(0.1)).alias("ok"),
    )


@query("F18_utc_timestamp", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) - 7200000000 WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) + 19800000000 END AS utc_us FROM events""")
def _f18(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    slot = F.col("event_id") % 4
    iso = F.concat(text, F.when(slot == 0, "+02:00").when(slot == 1, "Z").when(slot == 2, "-05:30").otherwise(""))
    return t.events.select("event_id", F.unix_micros(sc.utc_timestamp(iso)).alias("utc_us"))


CLAMP = "CAST(least(255, greatest(0, round_even({}, 0))) AS INTEGER)"


@query("F19_range_convert", f"""WITH r AS (SELECT o_orderkey, o_orderkey % 256 AS c FROM orders)
SELECT o_orderkey, {CLAMP.format('c * (255.0::DOUBLE / 219.0::DOUBLE) - 16.0::DOUBLE * (255.0::DOUBLE / 219.0::DOUBLE)')} AS luma_full,
 {CLAMP.format('c * (255.0::DOUBLE / 224.0::DOUBLE) + 128.0::DOUBLE * (1.0::DOUBLE - 255.0::DOUBLE / 224.0::DOUBLE)')} AS chroma_full,
 {CLAMP.format('c * (219.0::DOUBLE / 255.0::DOUBLE) + 16.0::DOUBLE')} AS luma_limited,
 {CLAMP.format('c * (224.0::DOUBLE / 255.0::DOUBLE) + 128.0::DOUBLE * (1.0::DOUBLE - 224.0::DOUBLE / 255.0::DOUBLE)')} AS chroma_limited FROM r""")
def _f19(t):
    code = F.col("o_orderkey") % 256
    return t.orders.select(
        "o_orderkey", sc.range_expand(code).alias("luma_full"), sc.range_expand(code, True).alias("chroma_full"),
        sc.range_compress(code).alias("luma_limited"), sc.range_compress(code, True).alias("chroma_limited"),
    )


@query("F20_plane_reorder", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 3, 9) AS red_first, CAST(embedding[1] AS DOUBLE) AS green_first,
 round(CAST(embedding[1] AS DOUBLE) * 2, 9) AS blue_first, len(embedding) * 3 AS elements,
 round(CAST(embedding[len(embedding)] AS DOUBLE) * 2, 9) AS blue_last FROM embeddings""", elements="INTEGER")
def _f20(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    stored = F.concat(e, F.transform(e, lambda x: x * 2), F.transform(e, lambda x: x * 3))
    rgb = t.embeddings.select("vec_id", sc.plane_reorder(stored).alias("p"))
    n = F.size("p")
    third = (n / 3).cast("int")
    at = lambda i: F.round(F.element_at("p", i), 9)
    return rgb.select(
        "vec_id", at(F.lit(1)).alias("red_first"), F.element_at("p", third + 1).alias("green_first"),
        at(third * 2 + 1).alias("blue_first"), n.alias("elements"), at(n).alias("blue_last"),
    )
