"""Media queries: a customer is a file, its orders are the packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import media as md
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query
from fleetgauge.plans.stats import FRAMES, frames

c = F.col

PACKETS = """
pk AS (SELECT run AS file, frame AS index, CASE WHEN extra > 0 OR run % 2 = 0 THEN frame * 20000000 + cents END AS pts, frame * 512 - CASE WHEN extra = 5 AND run % 3 = 0 THEN 600 ELSE 0 END AS dts, frame % 4 = 0 OR (extra = 1 AND run % 5 = 0) AS key FROM frames),
lagged AS (SELECT *, lag(pts) OVER (PARTITION BY file ORDER BY index) AS pp, lag(dts) OVER (PARTITION BY file ORDER BY index) AS pd FROM pk),
gaps AS (SELECT file, min(gap) AS min_gap, max(gap) AS max_gap, count(*) AS keyframe_count, min(index) AS first_keyframe FROM (SELECT file, index, index - lag(index) OVER (PARTITION BY file ORDER BY index) AS gap FROM pk WHERE key) GROUP BY 1),
facts AS (SELECT l.file, count(*) AS packet_count, min(index) FILTER (pts IS NULL OR pts <= pp) AS bad_pts_index, min(index) FILTER (dts IS NULL OR dts <= pd) AS bad_dts_index, any_value(keyframe_count) AS keyframe_count, any_value(first_keyframe) AS first_keyframe,
  any_value(min_gap) AS min_gap, any_value(max_gap) AS max_gap FROM lagged l LEFT JOIN gaps USING (file) GROUP BY 1)"""
WITH = f"WITH {FRAMES}, {PACKETS} "


def packets(t):
    pts = F.when((c("extra") > 0) | (c("run") % 2 == 0), c("frame") * 20_000_000 + c("cents"))
    dts = c("frame") * 512 - F.when((c("extra") == 5) & (c("run") % 3 == 0), 600).otherwise(0)
    key = (c("frame") % 4 == 0) | ((c("extra") == 1) & (c("run") % 5 == 0))
    return frames(t).select(
        c("run").alias("file"), c("frame").alias("index"), pts.cast("string").alias("pts"), dts.cast("string").alias("dts"),
        F.when(key, "K__").otherwise("___").alias("flags"))


KEY_OK = "(keyframe_count >= greatest(1, ceil(packet_count / 4.0)) AND (greatest(1, ceil(packet_count / 4.0)) = 1 OR coalesce(min_gap >= 3 AND max_gap <= 5, false)))"


@query("A44_keyframe_contract", WITH + f"SELECT file, keyframe_count, first_keyframe, min_gap, max_gap, {errors_sql(('packet 0 is not a keyframe', 'first_keyframe <> 0'), ('keyframe interval is off', f'NOT {KEY_OK}'))} AS errors FROM facts")
def _a44(t):
    facts = md.packet_facts(packets(t), "file", segment_rows=8)
    out = md.keyframe_contract(facts, c("packet_count"), F.lit(4))
    return out.select("file", "keyframe_count", "first_keyframe", "min_gap", "max_gap", joined())


def streams(t):
    """A video stream per customer, with an audio stream beside every fifth."""
    k = c("c_custkey")
    text = lambda v: v.cast("string")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.when(k % 11 == 0, "hevc").otherwise("h264").alias("codec_name"), F.lit("2560").alias("width"),
        F.when(k % 13 == 0, "1080").otherwise("1440").alias("height"), F.lit("yuv420p").alias("pix_fmt"), F.when(k % 17 == 0, "pc").otherwise("tv").alias("color_range"),
        F.lit("bt709").alias("color_space"), F.lit("bt709").alias("color_transfer"), F.lit("bt709").alias("color_primaries"),
        F.when(k % 7 == 0, "25/1").otherwise("48/2").alias("avg_frame_rate"), F.lit("24/1").alias("r_frame_rate"), F.lit("0").alias("has_b_frames"),
        text(k % 25).alias("nb_read_frames"), F.lit("N/A").alias("nb_frames"), F.format_string("%.3f", (k % 25) / 24.0).alias("duration"),
        F.when(k % 3 == 0, "N/A").otherwise(text(30_000_000 + (k % 100) * 100_000)).alias("bit_rate"))
    audio = F.struct(F.lit("audio").alias("codec_type"), *[F.lit(None).cast("string").alias(n) for n in (
        "codec_name", "width", "height", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries",
        "avg_frame_rate", "r_frame_rate", "has_b_frames", "nb_read_frames", "nb_frames", "duration", "bit_rate")])
    both = F.when(k % 5 == 0, F.array(video, audio)).otherwise(F.array(video))
    return t.customer.select(k.alias("file"), F.inline(both))


def contracts(t):
    fixed = {
        "codec": "h264", "width": 2560, "height": 1440, "pixel_format": "yuv420p", "color_range": "tv", "color_space": "bt709",
        "color_transfer": "bt709", "color_primaries": "bt709", "has_b_frames": 0, "fps": "24/1", "gop_frames": 4,
        "target_bitrate_mbps": 35.0, "bitrate_tolerance": 0.1, "container_duration": "0.5", "container_bit_rate": "34000000",
        "require_monotonic_pts": True, "require_monotonic_dts": True,
    }
    return t.customer.select(
        c("c_custkey").alias("file"), *[F.lit(v).alias(n) for n, v in fixed.items()], (c("c_custkey") % 25).cast("int").alias("frames"),
        F.when(c("c_custkey") % 19 == 0, "broken").alias("decode_error"))


# Every file of the contract table is judged, with or without packets.
CHECKS = WITH + f""", v AS (SELECT c_custkey AS file, c_custkey % 25 AS frames, f.* EXCLUDE (file, packet_count, keyframe_count), coalesce(packet_count, 0) AS packet_count, coalesce(keyframe_count, 0) AS keyframe_count,
 CASE WHEN c_custkey % 3 = 0 THEN 34000000 ELSE 30000000 + c_custkey % 100 * 100000 END AS bps FROM customer LEFT JOIN facts f ON f.file = c_custkey)"""
MEDIA_ERRORS = errors_sql(
    ("full_decode", "file % 19 = 0"), ("other_stream_count", "file % 5 = 0"), ("codec", "file % 11 = 0"), ("height", "file % 13 = 0"), ("color_range", "file % 17 = 0"),
    ("fps", "file % 7 = 0"), ("packet_count", "packet_count <> frames"), ("pts_monotonic", "bad_pts_index IS NOT NULL"), ("dts_monotonic", "bad_dts_index IS NOT NULL"),
    ("first_packet_keyframe", "first_keyframe IS DISTINCT FROM 0"), ("keyframe_interval", f"NOT {KEY_OK.replace('packet_count', 'frames')}"),
    ("bitrate", "abs(bps - 35000000) / 35000000.0 > 0.1"))


@query("A45_media_validation", CHECKS + f"SELECT file, frames AS frame_count, packet_count, bps AS video_bitrate_bps, round(abs(bps - 35000000) / 35000000.0, 9) AS bitrate_relative_delta, 21 AS checks, {MEDIA_ERRORS} AS errors FROM v")
def _a45(t):
    out = md.media_validation(streams(t), packets(t), contracts(t), "file", segment_rows=8)
    return out.select(
        "file", "frame_count", "packet_count", "video_bitrate_bps", F.round("bitrate_relative_delta", 9).alias("bitrate_relative_delta"),
        F.size("checks").alias("checks"), joined())


@query("A46_input_clip_validation", f"""SELECT c_custkey AS file, {errors_sql(('must contain one video stream', 'c_custkey % 5 = 0'), ('metadata mismatch for codec_name', 'c_custkey % 11 = 0'), ('metadata mismatch for height', 'c_custkey % 13 = 0'),
 ('metadata mismatch for color_range', 'c_custkey % 17 = 0'), ('avg_frame_rate differs', 'c_custkey % 7 = 0'), ('frame count differs', 'c_custkey % 25 <> 12'),
 ('duration differs', 'abs(CAST(printf(\'%.3f\', (c_custkey % 25) / 24.0) AS DOUBLE) - 0.5) > 1 / 24.0'))} AS errors FROM customer""")
def _a46(t):
    k = c("file")
    counted = streams(t).groupBy("file").agg(
        F.count("*").alias("stream_count"), F.max(F.when(c("codec_type") == "video", F.struct(
            "codec_type", "codec_name", "width", "height", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries", "has_b_frames",
            F.lit("1:1").alias("sample_aspect_ratio"), "r_frame_rate", "avg_frame_rate", "nb_read_frames", "nb_frames"))).alias("stream"))
    contract = F.struct(
        F.lit("h264").alias("codec_name"), F.lit(2560).alias("width"), F.lit(1440).alias("height"), F.lit("yuv420p").alias("pix_fmt"), F.lit("tv").alias("color_range"),
        *[F.lit("bt709").alias(n) for n in ("color_space", "color_transfer", "color_primaries")], F.lit(0).alias("has_b_frames"), F.lit("1:1").alias("sample_aspect_ratio"),
        F.lit("24/1").alias("fps"), F.lit(12).alias("frames"))
    data = counted.withColumns({"contract": contract, "container_duration": F.format_string("%.3f", (k % 25) / 24.0)})
    return md.input_clip_validation(data).select("file", joined())


@query("A47_stream_inventory", f"""SELECT c_custkey AS file, 1 AS video_streams, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS audio_streams, {errors_sql(('audio stream count: expected 1', 'c_custkey % 5 > 0'))} AS errors FROM customer""", video_streams="BIGINT", audio_streams="BIGINT")
def _a47(t):
    return md.stream_inventory(streams(t), "file", {"video": 1, "audio": 1}).select("file", "video_streams", "audio_streams", joined())


@query("A48_asset_lock_rows", """SELECT 'input_video' AS kind, c_mktsegment AS variant, c_name AS path, sha256(c_name) AS sha256, c_custkey AS size_bytes, 1280 AS width, 720 AS height, 1000 AS frames, '24/1' AS fps FROM customer
UNION ALL SELECT 'onnx', s_name, s_name || '.onnx', sha256(s_name), s_suppkey, 1280, 720, NULL, NULL FROM supplier""")
def _a48(t):
    videos = t.customer.select(
        c("c_mktsegment").alias("variant"), c("c_name").alias("path"), F.sha2("c_name", 256).alias("sha256"), c("c_custkey").alias("size_bytes"),
        F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(1000).alias("frames"), F.lit("24/1").alias("fps"))
    models = t.supplier.select(
        c("s_name").alias("variant"), F.concat("s_name", F.lit(".onnx")).alias("path"), F.sha2("s_name", 256).alias("sha256"), c("s_suppkey").alias("size_bytes"),
        F.lit(1280).alias("input_width"), F.lit(720).alias("input_height"))
    return md.asset_lock_rows(videos, models)


@query("A39_chroma_retention", f"""WITH v AS (SELECT o_orderkey, CAST(o_custkey % 50 AS DOUBLE) AS ui, 40.0 AS vi, CAST(o_orderkey % 60 AS DOUBLE) AS uo, CAST(o_custkey % 45 + 1 AS DOUBLE) AS vo FROM orders)
SELECT o_orderkey, round(CASE WHEN ui > 0 THEN uo / ui END, 9) AS u_retention_ratio, round(vo / vi, 9) AS v_retention_ratio, {errors_sql(('input chroma spans must be positive', 'ui <= 0'), ('output chroma spans must be positive', 'uo <= 0'),
 ('chroma retention is below 0.5', 'least(CASE WHEN ui > 0 THEN uo / ui END, vo / vi) < 0.5'))} AS errors FROM v""")
def _a39(t):
    k, cu = c("o_orderkey"), c("o_custkey")
    ten = F.lit(10.0).alias
    source = t.orders.select(k, ten("ULOW"), (10.0 + cu % 50).alias("UHIGH"), ten("VLOW"), F.lit(50.0).alias("VHIGH"))
    output = t.orders.select(k, ten("ULOW"), (10.0 + k % 60).alias("UHIGH"), ten("VLOW"), (11.0 + cu % 45).alias("VHIGH"))
    out = md.chroma_retention(source, output, ["o_orderkey"], 0.5)
    return out.select("o_orderkey", F.round("u_retention_ratio", 9).alias("u_retention_ratio"), F.round("v_retention_ratio", 9).alias("v_retention_ratio"), joined())
