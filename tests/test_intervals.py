import random

from pyspark.sql import functions as F

from fleetgauge.operators import intervals as iv
from fleetgauge.sources import readers as rd

SCHEMA = "k string, start long, end long"


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(p) for p in out]


def overlap(a, b):
    return sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x in merged(a) for y in merged(b))


def run_merge(spark, rows, width):
    out = iv.merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], width)
    return sorted((r.k, r.start, r.end) for r in out.collect())


def test_known_intervals(spark):
    rows = [("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("a", 12, 12), ("a", 20, 19)]
    assert run_merge(spark, rows, 4) == [("a", 0, 8), ("a", 10, 12)]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 4, 11)], SCHEMA)
    assert [r.overlap for r in iv.interval_overlap(left, right, ["k"], 3).collect()] == [5]


def test_random_sets_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 5}", s := rng.randrange(-50, 1000), s + rng.choice([0, 1, 3, 10, 400, -2])) for i in range(400)]
    other = [("hot" if rng.random() < 0.6 else f"k{i % 6}", s := rng.randrange(0, 1000), s + rng.randrange(0, 30)) for i in range(200)]
    keys = sorted({r[0] for r in rows})
    pick = lambda data, k: [(s, e) for key, s, e in data if key == k]
    for width in (1, 7, 100, 10**6):
        got = run_merge(spark, rows, width)
        assert got == sorted((k, s, e) for k in keys for s, e in merged(pick(rows, k)))
        left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
        out = {r.k: r.overlap for r in iv.interval_overlap(left, right, ["k"], width).collect()}
        back = {r.k: r.overlap for r in iv.interval_overlap(right, left, ["k"], width).collect()}
        assert out == back
        assert all(out.get(k, 0) == overlap(pick(rows, k), pick(other, k)) for k in keys)
    again = run_merge(spark, got, 50)
    assert again == got


def test_traces_with_dictionaries_of_their_own(spark, tmp_path):
    """The same trace twice under different ids, and one without a complete loop."""
    each = lambda make, schema: spark.createDataFrame([(k, *r) for k, shift in (("t", 0), ("u", 1), ("broken", 0)) for r in make(k, shift)], "trace_id string, " + schema)
    tables = {
        "StringIds": each(lambda k, d: [(1 + d, "pipeline.frame_loop"), (2 - d, "other")], "id long, value string"),
        "NVTX_EVENTS": each(lambda k, d: [(100, 1100 if k != "broken" else None, None, 1 + d), (0, 50, "warm-up", None)], "start long, end long, text string, textId long"),
        "CUPTI_ACTIVITY_KIND_KERNEL": each(lambda k, d: [(100, 400), (300, 700), (900, 1100)], "start long, end long"),
        "CUPTI_ACTIVITY_KIND_MEMCPY": each(lambda k, d: [(10, 20, 1024, 1 + d), (200, 250, 2048, 8 + d)], "start long, end long, bytes long, copyKind int"),
        "ENUM_CUDA_MEMCPY_OPER": each(lambda k, d: [(1 + d, "CUDA_MEMCPY_KIND_HTOD"), (2 + d, "CUDA_MEMCPY_KIND_DTOH"), (8 + d, "CUDA_MEMCPY_KIND_DTOD")], "id int, name string"),
        "ENUM_VIDEO_ENGINE_TYPE": each(lambda k, d: [(1 + d, "NVDEC"), (2 - 2 * d, "NVENC")], "id int, name string"),
        "GPU_VIDEO_ENGINE_WORKLOAD": each(lambda k, d: [(150, 250, 1 + d), (750, 1000, 2 - 2 * d)], "start long, end long, engineType int"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}")
    found = {r.trace_id: r for r in rd.analyse_trace(rd.read_trace_tables(spark, str(tmp_path)), ["trace_id"], "pipeline.frame_loop", 100, F.lit(2)).collect()}
    assert set(found) == {"t", "u", "broken"}
    for r in (found["t"], found["u"]):
        assert (r.kernel_coverage_percent, r.decode_overlap_percent, r.encode_overlap_percent) == (80.0, 100.0, 40.0)
        assert (r.startup_h2d_copies, r.loop_d2d_copies, r.loop_h2d_copies, r.loop_host_copies, r.window_error) == (1, 1, 0, False, None)
    assert found["broken"].window_error == "lacks one complete window" and found["broken"].kernel_coverage_percent is None


def test_missing_trace_tables_are_named(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, value string").write.parquet(f"{tmp_path}/StringIds")
    try:
        rd.read_trace_tables(spark, str(tmp_path))
    except FileNotFoundError as exc:
        assert "CUPTI_ACTIVITY_KIND_KERNEL, CUPTI_ACTIVITY_KIND_MEMCPY" in str(exc) and "StringIds" not in str(exc)
    else:
        raise AssertionError("missing tables were not reported")
