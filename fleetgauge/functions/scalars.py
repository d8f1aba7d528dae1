"""Column functions for media facts: rates, bitrates, colour, geometry, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Colour names and the bitrate exponent.
UNKNOWN_COLOUR = ("", "unknown", "reserved")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
BT2020_SPACES = ("bt2020nc", "bt2020c")
BT601_SPACES = ("smpte170m", "bt470bg", "bt470m")
BITRATE_EXPONENT = 0.6
# 8-bit limited-range code values.
CODE_MAX, LUMA_MIN, LUMA_RANGE, CHROMA_CENTRE, CHROMA_RANGE = 255.0, 16.0, 219.0, 128.0, 224.0

STREAM = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "codec_type", "codec_name", "width", "height", "pix_fmt", "color_range", "color_space",
        "color_transfer", "color_primaries", "r_frame_rate", "avg_frame_rate", "nb_frames",
        "nb_read_frames", "duration", "bit_rate", "has_b_frames",
    )]
)
PROBE = T.StructType(
    [
        T.StructField("streams", T.ArrayType(STREAM)),
        T.StructField("format", T.StructType([
            T.StructField("bit_rate", T.StringType()), T.StructField("duration", T.StringType())])),
    ]
)


def rational(text: Column) -> Column:
    """``n/d`` or a decimal as struct(num, den, value); a zero denominator means 0/1, junk null."""
    parts = F.split(text, "/")
    slashed = text.rlike(r"^\s*-?\d+\s*/\s*-?\d+\s*$")
    plain = text.rlike(r"^\s*-?\d+(\.\d+)?\s*$")
    places = F.length(F.regexp_extract(text, r"\.(\d+)", 1))
    den = F.when(slashed, F.trim(F.get(parts, F.lit(1))).try_cast("long")).when(
        plain, F.pow(F.lit(10), places).cast("long")
    )
    num = F.when(slashed, F.trim(F.get(parts, F.lit(0))).try_cast("long")).when(
        plain, F.replace(F.trim(text), F.lit("."), F.lit("")).try_cast("long")
    )
    flip = F.when(den < 0, -1).otherwise(1)
    num = F.when(den == 0, F.lit(0)).otherwise(num * flip)
    den = F.when(den == 0, F.lit(1)).otherwise(den * flip)
    return F.when(
        num.isNotNull() & den.isNotNull(),
        F.struct(
            num.cast("long").alias("num"),
            den.cast("long").alias("den"),
            (num.cast("double") / den.cast("double")).alias("value"),
        ),
    )


def rational_equal(a: Column, b: Column) -> Column:
    """Exact equality of two rate texts by cross multiplication; unreadable rates are unequal."""
    x, y = rational(a), rational(b)
    wide = lambda c: c.cast("decimal(19,0)")
    return F.coalesce(wide(x["num"]) * wide(y["den"]) == wide(y["num"]) * wide(x["den"]), F.lit(False))


def gop_frames(rate: Column) -> Column:
    """Keyframe distance of about one second, halves up; null for a rate that is not positive."""
    r = rational(rate)
    return F.when(
        r["num"] > 0,
        F.greatest(F.lit(1), F.floor((2 * r["num"] + r["den"]).cast("double") / (2 * r["den"]))),
    ).cast("long")


def gop_frames_contract(rate: Column) -> Column:
    """Keyframe distance as contracts state it, halves to even."""
    r = rational(rate)
    return F.when(r["num"] > 0, F.greatest(F.lit(1.0), F.bround(r["value"], 0))).cast("long")


def auto_bitrate(source, in_w, in_h, out_w, out_h, in_fps, out_fps) -> Column:
    """struct(bitrate, pixel_ratio, fps_ratio) for a source bitrate and the growth in pixels."""
    pixels = in_w * in_h
    pixel_ratio = F.when(pixels > 0, (out_w * out_h) / pixels).otherwise(1.0)
    fps_ratio = F.when((in_fps > 0) & (out_fps > 0), out_fps / in_fps).otherwise(1.0)
    rate = F.floor(source * F.pow(pixel_ratio * fps_ratio, F.lit(BITRATE_EXPONENT)))
    return F.struct(
        rate.cast("long").alias("bitrate"), pixel_ratio.alias("pixel_ratio"), fps_ratio.alias("fps_ratio")
    )


def resolve_bitrate(manual_mbps: Column, stream: Column, container: Column) -> Column:
    """struct(bitrate, source): manual, else stream, else container; null bitrate is an error."""
    nonzero = lambda c: F.when(c != 0, c)
    manual = (manual_mbps * 1_000_000).cast("long")
    origin = (
        F.when(manual.isNotNull(), "manual")
        .when(nonzero(stream).isNotNull(), "video stream")
        .when(nonzero(container).isNotNull(), "container")
        .otherwise("missing")
    )
    return F.struct(
        F.coalesce(manual, nonzero(stream), nonzero(container)).alias("bitrate"), origin.alias("source")
    )


def optional_int(text: Column) -> Column:
    """Positive whole number, else null (empty, ``N/A``, junk, zero and negatives)."""
    value = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    return F.when(value > 0, value)


def any_int(text: Column) -> Column:
    """Whole number of any sign, else null."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))


def finite_number(text: Column) -> Column:
    """Finite number from text, else null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def normalise_video(probe_json: Column) -> Column:
    """Metadata struct of the first video stream of a probe document; null when there is none."""
    probe = F.from_json(probe_json, PROBE)
    video = F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.coalesce(video["r_frame_rate"], F.lit("30/1"))
    return F.when(
        video.isNotNull() & any_int(video["width"]).isNotNull() & any_int(video["height"]).isNotNull(),
        F.struct(
            any_int(video["width"]).alias("width"),
            any_int(video["height"]).alias("height"),
            rational(rate)["value"].alias("fps"),
            rate.alias("fps_text"),
            F.coalesce(any_int(video["nb_frames"]), F.lit(0)).alias("frames"),
            video["pix_fmt"].alias("pix_fmt"),
            video["color_range"].alias("color_range"),
            video["color_space"].alias("color_space"),
            video["color_transfer"].alias("color_transfer"),
            video["color_primaries"].alias("color_primaries"),
            optional_int(video["bit_rate"]).alias("video_bit_rate"),
            optional_int(probe["format"]["bit_rate"]).alias("container_bit_rate"),
        ),
    )


def known_or(value: Column, default: Column | str) -> Column:
    """The value unless it is missing, empty, ``unknown`` or ``reserved``."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(value.isNull() | value.isin(*UNKNOWN_COLOUR), default).otherwise(value)


def colour_defaults(width, height, color_range, space, transfer, primaries) -> Column:
    """Colour description with gaps filled from the resolution."""
    default = F.when((width >= 1280) | (height >= 720), "bt709").otherwise("smpte170m")
    return F.struct(
        known_or(color_range, "tv").alias("color_range"),
        known_or(space, default).alias("color_space"),
        known_or(transfer, default).alias("color_transfer"),
        known_or(primaries, default).alias("color_primaries"),
    )


def colour_family(space: Column) -> Column:
    return (
        F.when(space.isin(*BT2020_SPACES), "bt2020").when(space.isin(*BT601_SPACES), "bt601").otherwise("bt709")
    )


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(*HDR_TRANSFERS), F.lit(False))


def crop_rectangle(x, y, w, h, out_w, out_h) -> Column:
    """Fractions of a frame as an integer rectangle inside it (halves to even)."""
    whole = lambda c: F.bround(c.cast("double"), 0).cast("long")
    width = F.greatest(F.lit(1), whole(out_w * w))
    height = F.greatest(F.lit(1), whole(out_h * h))
    return F.struct(
        F.least(whole(out_w * x), out_w - width).cast("long").alias("x"),
        F.least(whole(out_h * y), out_h - height).cast("long").alias("y"),
        width.cast("long").alias("width"),
        height.cast("long").alias("height"),
    )


def is_dynamic(dims: Column) -> Column:
    """Any dimension that is symbolic (text), missing or not positive; ``dims`` is array<string>."""
    return F.exists(dims, lambda d: F.coalesce(d.try_cast("int") <= 0, F.lit(True)))


def scale_of(before: Column, after: Column) -> Column:
    """Uniform whole-number scale of two [1, 3, H, W] shapes, else null."""
    at = lambda a, i: F.get(a, F.lit(i))
    ok = (
        (F.size(before) == 4) & (F.size(after) == 4)
        & F.forall(before, lambda d: d > 0) & F.forall(after, lambda d: d > 0)
        & (at(before, 0) == 1) & (at(after, 0) == 1) & (at(before, 1) == 3) & (at(after, 1) == 3)
    )
    rows, cols = at(after, 2) / at(before, 2), at(after, 3) / at(before, 3)
    even = (at(after, 2) % at(before, 2) == 0) & (at(after, 3) % at(before, 3) == 0) & (rows == cols)
    return F.when(ok, F.when(even, rows.cast("long")))


def psnr(mse: Column) -> Column:
    """10 log10(1 / mse); null for an exact match."""
    return F.when(mse > 0, 10 * F.log10(1.0 / mse))


def psnr_rmse(rmse: Column) -> Column:
    """20 log10(1 / rmse); 200 for an exact match."""
    return F.when(rmse == 0, F.lit(200.0)).otherwise(20 * F.log10(1.0 / rmse))


CANDIDATE_ID = r"^[a-z0-9][a-z0-9-]*$"


def candidate_id(implementation, streams, auto_threads, graph) -> Column:
    """``<implementation>-s<n>[-tauto]-g<0|1>``; null when the name does not fit the id pattern."""
    text = F.concat(
        implementation, F.lit("-s"), streams.cast("string"),
        F.when(auto_threads, "-tauto").otherwise(""), F.lit("-g"), graph.cast("int").cast("string"),
    )
    return F.when(text.rlike(CANDIDATE_ID), text)


def duration_matches(actual, frames, fps) -> Column:
    """Duration within one frame (plus 1e-6 s) of frames / fps; a missing duration fails."""
    return F.coalesce(F.abs(actual - frames / fps) <= 1.0 / fps + 1e-6, F.lit(False))


def bitrate_delta(actual, target) -> Column:
    return F.abs(actual - target) / target


def bitrate_matches(actual, target, tolerance) -> Column:
    return F.coalesce(bitrate_delta(actual, target) <= tolerance, F.lit(False))


def utc_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text that states its offset, else null."""
    offset = text.rlike(r"T?\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(offset, F.try_to_timestamp(text))


def _saturate(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(value, 0).cast("int")))


def range_expand(code: Column, chroma: bool = False) -> Column:
    """Limited-range code value to full range, saturated to 0..255."""
    if chroma:
        k = CODE_MAX / CHROMA_RANGE
        return _saturate(code * k + CHROMA_CENTRE * (1.0 - k))
    k = CODE_MAX / LUMA_RANGE
    return _saturate(code * k - LUMA_MIN * k)


def range_compress(code: Column, chroma: bool = False) -> Column:
    """Full-range code value to limited range, saturated to 0..255."""
    if chroma:
        k = CHROMA_RANGE / CODE_MAX
        return _saturate(code * k + CHROMA_CENTRE * (1.0 - k))
    return _saturate(code * (LUMA_RANGE / CODE_MAX) + LUMA_MIN)


def plane_reorder(values: Column) -> Column:
    """Planes stored green, blue, red as red, green, blue."""
    third = (F.size(values) / 3).cast("int")
    return F.concat(
        F.slice(values, third * 2 + 1, third), F.slice(values, F.lit(1), third), F.slice(values, third + 1, third)
    )


def fixed(value: Column, digits: int, sign: bool = False, suffix: str = "") -> Column:
    """Text with fixed decimals, rounding the exact binary value with halves to even.

    JVM formatting rounds the shortest decimal form half up, which differs at ties.  The value
    is split in two halves so that both products with the power of ten are exact.
    """
    scale = float(10**digits)
    size = F.abs(value)
    wide = size * 134217729.0
    high = wide - (wide - size)
    top, rest = high * scale, (size - high) * scale
    left = (top - F.floor(top)) + rest
    whole = F.floor(top) + F.floor(left)
    past_half = left - F.floor(left) - 0.5
    up = (past_half > 0) | ((past_half == 0) & (whole % 2 == 1))
    rounded = (whole + F.when(up, 1).otherwise(0)) / scale
    signed = F.when(value < 0, -rounded).otherwise(rounded)
    return F.format_string(f"%{'+' if sign else ''}.{digits}f{suffix}", signed)
