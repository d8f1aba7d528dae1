from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.functions import text as tx
from fleetgauge.operators import media as md
from fleetgauge.operators import sequence as sq

STREAM_FIELDS = (
    "codec_type", "codec_name", "width", "height", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries",
    "avg_frame_rate", "r_frame_rate", "has_b_frames", "nb_read_frames", "nb_frames", "duration", "bit_rate")
GOOD = dict(zip(STREAM_FIELDS, (
    "video", "h264", "2560", "1440", "yuv420p", "tv", "bt709", "bt709", "bt709", "24/1", "24/1", "0", "48", None, "2.0", "35000000")))


def judge(spark, change=None, packets=None, extra_stream=False, segment_rows=10):
    stream = {**GOOD, **(change or {})}
    rows = [tuple(["f", *[stream[n] for n in STREAM_FIELDS]])]
    if extra_stream:
        rows.append(tuple(["f", "audio", *[None] * 15]))
    streams = spark.createDataFrame(rows, "file string, " + ", ".join(f"{n} string" for n in STREAM_FIELDS))
    packets = packets if packets is not None else [(i, i, "K__" if i % 24 == 0 else "___") for i in range(48)]
    packet_rows = spark.createDataFrame([("f", n, None if p is None else str(p), str(d), flags) for n, (p, d, flags) in enumerate(packets)],
                                        "file string, index long, pts string, dts string, flags string")
    contract = spark.createDataFrame(
        [("f", "h264", 2560, 1440, "yuv420p", "tv", "bt709", "bt709", "bt709", 0, "24/1", 48, 24, 35.0, 0.1, "2.0", "1", None, True, True)],
        "file string, codec string, width int, height int, pixel_format string, color_range string, color_space string, color_transfer string, color_primaries string, "
        "has_b_frames int, fps string, frames int, gop_frames int, target_bitrate_mbps double, bitrate_tolerance double, container_duration string, "
        "container_bit_rate string, decode_error string, require_monotonic_pts boolean, require_monotonic_dts boolean")
    return md.media_validation(streams, packet_rows, contract, "file", segment_rows).first()


def test_good_output_passes(spark):
    r = judge(spark)
    assert r.errors == [] and r.valid and len(r.checks) == 21 and all(r.checks.values())


def test_single_mutations(spark):
    assert judge(spark, {"codec_name": "hevc"}).errors == ["codec"]
    assert judge(spark, {"avg_frame_rate": "25/1"}).errors == ["fps"]
    assert judge(spark, {"avg_frame_rate": "48/2"}).errors == []
    assert judge(spark, {"bit_rate": "28000000"}).errors == ["bitrate"]
    assert judge(spark, {"duration": "2.04"}).errors == [] and judge(spark, {"duration": "2.05"}).errors == ["duration"]
    assert judge(spark, extra_stream=True).errors == ["other_stream_count"]


def test_packets(spark):
    plain = [(i, i, "K__" if i % 24 == 0 else "___") for i in range(48)]
    repeated = [p if n != 20 else (p[0], 19, p[2]) for n, p in enumerate(plain)]
    for size in (5, 20, 1000):
        r = judge(spark, packets=repeated, segment_rows=size)
        assert r.errors == ["dts_monotonic"] and r.bad_dts_index == 20
    assert judge(spark, packets=[(p, d, "___" if n == 0 else f) for n, (p, d, f) in enumerate(plain)]).errors == ["first_packet_keyframe", "keyframe_interval"]
    for size in (7, 1000):
        late = [(p, d, "K__" if n in (0, 27) else "___") for n, (p, d, _) in enumerate(plain)]
        r = judge(spark, packets=late, segment_rows=size)
        assert r.errors == ["keyframe_interval"] and (r.min_gap, r.max_gap) == (27, 27)
    assert judge(spark, packets=plain[:47]).errors == ["packet_count"]


def test_logs(spark):
    df = spark.createDataFrame([("PSNR average:31.5 x\nPSNR y:1 average:inf min",), ("nothing",)], "t string")
    first, second = [r.m for r in df.select(tx.parse_metric_log(F.col("t"), "psnr").alias("m")).collect()]
    assert (first.found, first.exact, first.value) == (True, True, None) and second.found is False
    levels = spark.createDataFrame([("mean_volume: -inf dB\nmax_volume: -2 dB",)], "t string")
    r = tx.parse_level_log(levels, "t", -60.0).first()
    assert r.mean_dbfs == float("-inf") and r.peak_dbfs == -2.0 and r.errors == ["mean level is below -60"]


def test_oom_needs_a_marker(spark):
    texts = ["host out of memory", "cudaMalloc: out of memory", "CUDA_ERROR_OUT_OF_MEMORY", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(R.classify_oom(F.col("t")).alias("x")).collect()] == [False, True, True, False]


def test_booleans_are_not_numbers(spark):
    docs = ['{"a":{"b":true}}', '{"a":{"b":"1"}}', '{"a":{"b":1.5}}', '{"a":{"b":2}}', '{"a":{}}', "broken"]
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r.x for r in df.select(R.strict_metric(F.col("d"), "$.a.b").alias("x")).collect()] == [None, None, 1.5, 2.0, None, None]


def test_idle_gaps_and_phases(spark):
    s = 1_000_000
    df = spark.createDataFrame([("c", 1, 0, 10 * s), ("c", 2, 40 * s, 50 * s), ("c", 3, 75 * s, 70 * s)], "k string, n long, a long, b long")
    out = sq.idle_gaps(df, ["k"], ["n"], "a", "b", 30.0, F.col("n")).orderBy("n").collect()
    assert [r.idle_seconds for r in out] == [None, 30.0, 25.0]
    assert [r.errors for r in out] == [[], [], ["finishes before it starts", "did not observe the required 30s idle interval"]]
    marks = spark.createDataFrame([("r", "b", 5, 0, 9), ("r", "a", 5, 0, 9), ("r", "z", 10, 0, 9)], "k string, name string, t long, lo long, hi long")
    got = {r.interval: (r.length, r.outside) for r in sq.phase_intervals(marks, ["k"], "name", "t", "lo", "hi", 3).collect()}
    assert got == {"a_to_b": (0, False), "b_to_z": (5, True)}
