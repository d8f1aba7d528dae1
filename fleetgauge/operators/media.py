"""Media contracts: streams, packets, keyframes, durations, bitrates and prepared inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.functions import scalars as sc
from fleetgauge.operators.segments import SEGMENT, by_width, spread
from fleetgauge.operators.sequence import SEGMENT_ROWS


def packet_facts(packets: DataFrame, file: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per file: packets, first bad PTS and DTS index, keyframes and their gap range."""
    key = F.coalesce(F.col("flags"), F.lit("")).contains("K")
    data = packets.select(
        file, "index", sc.any_int(F.col("pts")).alias("pts"), sc.any_int(F.col("dts")).alias("dts"), key.alias("key"))
    data = data.withColumn(SEGMENT, by_width(F.col("index"), segment_rows))
    local = Window.partitionBy(file, SEGMENT).orderBy("index")
    key_index = F.when(F.col("key"), F.col("index"))
    last_key = F.max(key_index).over(local.rowsBetween(Window.unboundedPreceding, -1))
    stalls = lambda n: F.when(F.col(n).isNull() | (F.col(n) <= F.lag(n).over(local)), F.col("index"))
    row = F.struct("index", "pts", "dts")
    # One row per file and segment: what is wrong inside, and its first and last packet.
    parts = spread(data, [file]).withColumns({
        "_row": row, "_pts": stalls("pts"), "_dts": stalls("dts"), "_key": key_index, "_gap": key_index - last_key,
    }).groupBy(file, SEGMENT).agg(
        F.count("*").alias("_n"), F.count("_key").alias("_keys"), F.min("_row").alias("_head"), F.max("_row").alias("_tail"),
        F.min("_pts").alias("_pts"), F.min("_dts").alias("_dts"), F.min("_key").alias("_first"), F.max("_key").alias("_last"),
        F.min("_gap").alias("_low"), F.max("_gap").alias("_high"),
    )
    across = Window.partitionBy(file).orderBy(SEGMENT)
    before = F.lag("_tail").over(across)
    earlier_key = F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1))
    joint = lambda n: F.when(F.col(f"_head.{n}") <= before[n], F.col("_head.index"))
    parts = parts.withColumns({"_jp": joint("pts"), "_jd": joint("dts"), "_jg": F.col("_first") - earlier_key})
    return parts.groupBy(file).agg(
        F.sum("_n").alias("packet_count"), F.least(F.min("_pts"), F.min("_jp")).alias("bad_pts_index"),
        F.least(F.min("_dts"), F.min("_jd")).alias("bad_dts_index"), F.sum("_keys").alias("keyframe_count"),
        F.min("_first").alias("first_keyframe"), F.least(F.min("_low"), F.min("_jg")).alias("min_gap"),
        F.greatest(F.max("_high"), F.max("_jg")).alias("max_gap"),
    )


def keyframe_ok(frames: Column, gop: Column) -> Column:
    """Enough keyframes, every gap within one frame of the contract (gaps given by their range)."""
    expected = F.greatest(F.lit(1), F.ceil(frames / gop))
    gaps = F.coalesce((F.col("min_gap") >= gop - 1) & (F.col("max_gap") <= gop + 1), F.lit(False))
    return R.when_present(F.col("keyframe_count") >= expected) & ((expected == 1) | gaps)


def keyframe_contract(facts: DataFrame, frames: Column, gop: Column) -> DataFrame:
    first = R.when_present(F.col("first_keyframe") == 0)
    return facts.withColumn("errors", R.labels([
        ("packet 0 is not a keyframe", ~first), ("keyframe interval is off", ~keyframe_ok(frames, gop))]))


def stream_facts(streams: DataFrame, file: str) -> DataFrame:
    """One row per file: stream counts and the single video stream (null unless exactly one)."""
    video = F.col("codec_type") == "video"
    held = F.struct(*[n for n in streams.columns if n not in (file, "codec_type")])
    return streams.withColumn("_v", F.coalesce(video, F.lit(False))).groupBy(file).agg(
        F.count_if("_v").alias("video_streams"), F.count_if(~F.col("_v")).alias("other_streams"),
        F.max(F.when(F.col("_v"), held)).alias("_video"),
    ).withColumn("video", F.when(F.col("video_streams") == 1, F.col("_video"))).drop("_video")


def stream_inventory(streams: DataFrame, file: str, expected: dict[str, int]) -> DataFrame:
    """Streams per type against the expected counts."""
    counts = {kind: F.count_if(F.coalesce(F.col("codec_type") == kind, F.lit(False))).alias(f"{kind}_streams") for kind in expected}
    return streams.groupBy(file).agg(*counts.values()).withColumn("errors", R.labels([
        (f"{kind} stream count: expected {n}", F.col(f"{kind}_streams") != n) for kind, n in expected.items()]))


def media_validation(streams: DataFrame, packets: DataFrame, contracts: DataFrame, file: str,
                     segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """All media checks of every file as a ``checks`` map, observed values and ordered errors.

    ``contracts`` holds one row per file: codec, width, height, pixel_format, color_range,
    color_space, color_transfer, color_primaries, has_b_frames, fps, frames, gop_frames,
    target_bitrate_mbps, bitrate_tolerance, container_duration, container_bit_rate,
    decode_error, require_monotonic_pts, require_monotonic_dts.
    """
    c = F.col
    v = lambda n: c(f"video.{n}")
    joined = (
        contracts.join(stream_facts(streams, file), file, "left")
        .join(packet_facts(packets, file, segment_rows), file, "left")
        .withColumns({n: F.coalesce(n, F.lit(0)) for n in ("video_streams", "other_streams", "packet_count", "keyframe_count")})
    )
    rate = F.coalesce(F.nullif(v("avg_frame_rate"), F.lit("")), v("r_frame_rate"))
    fps = sc.rational(c("fps"))["value"]
    frames = F.coalesce(sc.any_int(v("nb_read_frames")), sc.any_int(v("nb_frames")))
    duration = F.coalesce(sc.finite_number(v("duration")), sc.finite_number(c("container_duration")))
    bitrate = F.coalesce(F.nullif(sc.any_int(v("bit_rate")), F.lit(0).cast("long")), sc.any_int(c("container_bit_rate")))
    target = c("target_bitrate_mbps") * 1_000_000
    same = lambda a, b: a.eqNullSafe(b)
    skip = lambda optional, check: F.when(optional, check)
    checks: dict[str, Column] = {
        "full_decode": c("decode_error").isNull(),
        "video_stream_count": c("video_streams") == 1,
        "other_stream_count": c("other_streams") == 0,
        "codec": same(v("codec_name"), c("codec")),
        "width": same(sc.any_int(v("width")), c("width").cast("long")),
        "height": same(sc.any_int(v("height")), c("height").cast("long")),
        "pixel_format": same(v("pix_fmt"), c("pixel_format")),
        **{n: same(v(n), c(n)) for n in ("color_range", "color_space", "color_transfer", "color_primaries")},
        "has_b_frames": skip(c("has_b_frames").isNotNull(), same(sc.any_int(v("has_b_frames")), c("has_b_frames").cast("long"))),
        "fps": sc.rational_equal(rate, c("fps")),
        "frame_count": same(frames, c("frames").cast("long")),
        "packet_count": c("packet_count") == c("frames"),
        "duration": sc.duration_matches(duration, c("frames"), fps),
        "pts_monotonic": skip(c("require_monotonic_pts"), c("bad_pts_index").isNull()),
        "dts_monotonic": skip(c("require_monotonic_dts"), c("bad_dts_index").isNull()),
        "first_packet_keyframe": R.when_present(c("first_keyframe") == 0),
        "keyframe_interval": skip(c("gop_frames").isNotNull(), keyframe_ok(c("frames"), c("gop_frames"))),
        "bitrate": skip(target.isNotNull(), sc.bitrate_matches(bitrate, target, c("bitrate_tolerance"))),
    }
    result = joined.withColumns({f"_k_{n}": check for n, check in checks.items()})
    pairs = F.map_filter(
        F.create_map(*[x for n in checks for x in (F.lit(n), c(f"_k_{n}"))]), lambda _, ok: ok.isNotNull())
    return result.select(
        file, pairs.alias("checks"), R.labels([(n, ~c(f"_k_{n}")) for n in checks]).alias("errors"),
        frames.alias("frame_count"), "packet_count", duration.alias("duration_sec"), bitrate.alias("video_bitrate_bps"),
        sc.bitrate_delta(bitrate, target).alias("bitrate_relative_delta"), "keyframe_count", "min_gap", "max_gap",
        "bad_pts_index", "bad_dts_index",
    ).withColumn("valid", F.size("errors") == 0)


# Prepared inputs are H.264 with square pixels.
INPUT_FIELDS = ("codec_name", "width", "height", "pix_fmt", "color_range", "color_space", "color_transfer",
                "color_primaries", "has_b_frames", "sample_aspect_ratio")


def input_clip_validation(df: DataFrame) -> DataFrame:
    """Prepared inputs (struct ``stream``) against their contract (struct ``contract``)."""
    c = F.col
    fps = sc.rational(c("contract.fps"))["value"]
    frames = F.coalesce(F.nullif(c("stream.nb_read_frames"), F.lit("")), c("stream.nb_frames"))
    late = F.abs(sc.finite_number(c("container_duration")) - c("contract.frames") / fps) > 1 / fps
    return df.withColumn("errors", R.labels([
        ("must contain one video stream", R.differs(c("stream_count").cast("long"), F.lit(1).cast("long")) | R.differs(c("stream.codec_type"), F.lit("video"))),
        *[(f"metadata mismatch for {f}", R.differs(c(f"stream.{f}").cast("string"), c(f"contract.{f}").cast("string"))) for f in INPUT_FIELDS],
        *[(f"{f} differs", ~sc.rational_equal(F.coalesce(c(f"stream.{f}"), F.lit("0/1")), c("contract.fps"))) for f in ("r_frame_rate", "avg_frame_rate")],
        ("frame count differs", R.differs(frames, c("contract.frames").cast("string"))),
        ("duration is unavailable", sc.finite_number(c("container_duration")).isNull()),
        ("duration differs", late),
    ]))


def chroma_retention(source: DataFrame, output: DataFrame, keys: Sequence[str], minimum: float) -> DataFrame:
    """Percentile span per chroma plane and the part of it that the output keeps."""
    spans = lambda df, tag: df.select(
        *keys, (F.col("UHIGH") - F.col("ULOW")).alias(f"u_{tag}"), (F.col("VHIGH") - F.col("VLOW")).alias(f"v_{tag}"))
    joined = spans(source, "in").join(spans(output, "out"), list(keys))
    ratio = lambda p: F.when(F.col(f"{p}_in") > 0, F.col(f"{p}_out") / F.col(f"{p}_in"))
    flat = lambda tag: ~(R.finite_bounds(F.col(f"u_{tag}")) & R.finite_bounds(F.col(f"v_{tag}")))
    return joined.withColumns({
        "u_retention_ratio": ratio("u"), "v_retention_ratio": ratio("v"),
        "errors": R.labels([
            ("input chroma spans must be positive", flat("in")), ("output chroma spans must be positive", flat("out")),
            (f"chroma retention is below {minimum:g}", F.least(ratio("u"), ratio("v")) < minimum),
        ]),
    })


def asset_lock_rows(videos: DataFrame, models: DataFrame) -> DataFrame:
    """Lock table of input videos and models: kind, variant, path, hash, size, geometry."""
    shared = ["variant", "path", "sha256", "size_bytes"]
    v = videos.select(F.lit("input_video").alias("kind"), *shared, "width", "height", "frames", "fps")
    m = models.select(F.lit("onnx").alias("kind"), *shared, F.col("input_width").alias("width"), F.col("input_height").alias("height"))
    return v.unionByName(m, allowMissingColumns=True)
