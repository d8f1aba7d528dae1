import random
import statistics

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.functions import scalars as sc
from fleetgauge.functions import rules as R
from fleetgauge.operators import search as sr
from fleetgauge.operators import sequence as sq
from fleetgauge.operators import stats as st
from fleetgauge.operators import segments as sg
from fleetgauge.operators.quantiles import exact_quantiles
from fleetgauge.operators.segments import by_width, previous_row, row_numbers, running, trailing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(700)] + [("flat", 2.5)] * 30 + [("few", float(v)) for v in (3, 1, 2, 10)]
    rows += [("one", 7.0), ("one", None), ("nulls", None), (None, 4.0), (None, 5.0), ("outlier", 1e300)] + [("outlier", rng.uniform(-1, 1)) for _ in range(501)]
    rows += [("signs", v) for v in (-1e-310, 0.0, -0.0, 1e-310, -5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"m": ("v", 0.5), "p": ("v", 0.99), "lo": ("v", 0.0), "hi": ("v", 1.0)}
    got = {r.k: r for r in exact_quantiles(df, ["k"], wanted, {"n": "v"}).collect()}
    assert set(got) == {k for k, _ in rows}
    for key in got:
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key].n == len(values)
        for name, q in (("m", 50), ("p", 99), ("lo", 0), ("hi", 100)):
            assert got[key][name] is None if not values else np.isclose(got[key][name], np.percentile(values, q), rtol=1e-12)


def test_quantiles_of_a_million_equal_values(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 3, 9.0).otherwise(2.5).alias("v"))
    assert tuple(exact_quantiles(df, ["k"], {"m": ("v", 0.5), "hi": ("v", 1.0)}).first()) == ("k", 2.5, 9.0)


def test_one_median_reads_its_input_twice_at_most(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = st.suite_statistics(df, ["l_suppkey"], "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_ordered_operators_match_plain_windows_with_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(50)]), n, rng.choice([None, 1.0, 2.0])) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v double")
    segment = sg.by_width(F.col("at"), 7)
    order = Window.partitionBy("k").orderBy("at", "id")
    want = df.select("id", F.lag(F.struct("v")).over(order).alias("x"), F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(order).alias("n"))
    got = sg.previous_row(df, ["k"], ["at", "id"], ["v"], segment, "x").select("id", "x")
    got = got.join(sg.running(df, ["k"], ["at", "id"], segment, s=("sum", "v")).select("id", "s"), "id")
    got = got.join(sg.row_numbers(df, ["k"], ["at", "id"], segment, "n").select("id", "n"), "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    means = sg.trailing(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", None, 9.0), (None, 1, 5.0)], "k string, i long, v double"), ["k"], "i", "v", 2)
    assert {(r.k, r.i, r.moving_mean) for r in means.collect()} == {("a", 1, 1.0), ("a", 2, 2.0), ("a", None, None), (None, 1, 5.0)}


def test_suite_statistics(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 12.0), ("a", 11.0), ("z", 0.0)], "k string, v double")
    out = {r.k: r for r in st.suite_statistics(df, ["k"], "v").collect()}
    assert (out["a"].median_fps, out["a"].min_fps, out["a"].max_fps, out["a"].relative_spread) == (11.0, 10.0, 12.0, 2 / 11)
    assert out["z"].relative_spread is None


def test_stability_verdicts(spark):
    series = {
        "stable": [100, 101, 100.5], "extra": [100, 120, 100], "outlier": [100, 101, 150, 100.5, 100.2],
        "unstable": [100, 130, 160, 190, 220], "tie": [100, 100, 100, 120, 120], "two": [1, 2],
    }
    rows = [(k, i + 1, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    out = {r.k: r for r in st.stability(spark.createDataFrame(rows, "k string, r int, v double"), ["k"], "r", "v", 0.05).collect()}
    assert out["two"].stability == "incomplete" and out["two"].full_spread is None
    assert {k: r.stability for k, r in out.items()} == {
        "stable": "stable", "extra": "needs-extra-runs", "outlier": "stable-with-one-outlier", "unstable": "unstable", "tie": "unstable", "two": "incomplete"}
    assert out["outlier"].outlier_round == 3


def test_stability_tie_goes_to_the_earliest_rounds(spark):
    # Leaving out round 1 or round 5 gives the same spread; rounds 1-4 come first.
    rows = [("k", i + 1, float(v)) for i, v in enumerate([90, 100, 100, 100, 110])]
    r = st.stability(spark.createDataFrame(rows, "k string, r int, v double"), ["k"], "r", "v", 0.1).first()
    spreads = [0.1, 0.2, 0.1]
    assert r.consensus_spread == min(spreads) and r.outlier_round == 5


def test_stage_profile(spark):
    rows = [("r", 0, "a", 2.0), ("r", 0, "b", 3.0), ("r", 1, "a", 1.5), ("r", 1, "b", 4.0)]
    out = {r.stage: r.stage_ms for r in st.stage_profile(spark.createDataFrame(rows, "run string, f long, stage string, ms double"), ["run"], "f", "stage", "ms", 1).collect()}
    assert out == {"a": 1.5, "b": 4.0}
    short = {r.stage: r.stage_ms for r in st.stage_profile(spark.createDataFrame(rows[:2], "run string, f long, stage string, ms double"), ["run"], "f", "stage", "ms", 1).collect()}
    assert short == {"a": 2.0, "b": 3.0}


def points(spark, values, graph=None):
    rows = [("i", n, bool(g), f, f"c{n}{int(bool(g))}") for n, f, g in values]
    return spark.createDataFrame(rows, "implementation string, num_streams int, cuda_graph boolean, median_fps double, candidate_id string")


K = ["implementation"]


def test_confirmed_decline(spark):
    df = points(spark, [(1, 10.0, 0), (2, 12.0, 0), (3, 11.7, 0), (4, 11.5, 0)])
    assert [r.declined for r in sr.confirmed_decline(df, K, 0.01, 2).orderBy("num_streams").collect()] == [False, False, False, True]


def test_sentinel_and_boundary(spark):
    for top, expected in ((12.2, True), (12.1, False)):
        df = points(spark, [(1, 10.0, 0), (2, 12.0, 0), (9, top, 0)])
        assert sr.sentinel_recovers(df, K, F.col("num_streams") == 9, 0.01).first().recovers is expected
        assert sr.upper_boundary_open(df, K, 0.01).first().open is expected
    assert sr.upper_boundary_open(points(spark, [(1, 10.0, 0)]), K, 0.01).first().open is True


def test_shortlist_and_peak(spark):
    df = points(spark, [(1, 9.0, 0), (2, 12.0, 0), (3, 11.8, 0), (4, 11.9, 0)])
    assert [r.num_streams for r in sr.shortlist(df, K, 3).orderBy("rank").collect()] == [2, 4, 3]
    best = sr.peak_equivalent(points(spark, [(5, 25.0, 0), (6, 25.2, 0), (6, 25.25, 1)]), K, 0.01).first()
    assert (best.num_streams, best.cuda_graph) == (5, False)


def test_search_completion_accepts_proven_ends(spark):
    declined = [(1, 10.0, 0), (2, 12.0, 0), (3, 11.0, 0), (4, 10.9, 0), (6, 10.0, 0)]
    full = [(n, 10.0 + (2 - abs(n - 3)), 0) for n in range(1, 7)]
    cases = {
        "a": (declined, "decline-confirmed", 4, None, []), "b": (full, "range-exhausted", None, None, []),
        "c": (full[:3], "resource-ceiling", None, 4, []), "d": (declined[:4], "resource-ceiling", 4, 6, []),
        "e": (full[:4], "range-exhausted", None, None, ["did not exhaust the range"]),
        "f": (declined + [(5, 10.5, 0)], "decline-confirmed", 4, None, ["changed the decline-confirmed range"]),
        "g": (full[:3], "resource-ceiling", None, 6, ["skipped points before its resource ceiling"]),
    }
    data = None
    for name, (rows, *_) in cases.items():
        part = points(spark, rows).withColumn("implementation", F.lit(name))
        data = part if data is None else data.unionByName(part)
    states = spark.createDataFrame([(n, r, e, l) for n, (_, r, e, l, _) in cases.items()], "implementation string, completion_reason string, early_stop int, limit_streams int")
    out = {r.implementation: r.errors for r in sr.search_completion(data, states, K, 1, 6, 0.01, 2).collect()}
    assert out == {n: case[4] for n, case in cases.items()}


def test_segment_helpers_equal_plain_windows(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else "k", i, rng.randrange(100), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long, flag boolean")
    series = {k: sorted((r[1:] for r in rows if r[0] == k)) for k in ("hot", "k")}
    for width in (1, 17, 10**6):
        seg = by_width(F.col("i"), width)
        numbered = {(r.k, r.i): r.position for r in row_numbers(df, ["k"], ["i"], seg).collect()}
        totals = {(r.k, r.i): (r.s, r.m) for r in running(df, ["k"], ["i"], seg, inclusive=False, s=("sum", "v"), m=("max", "v")).collect()}
        prev = {(r.k, r.i): r.p for r in previous_row(df, ["k"], ["i"], ["v"], seg, "p").collect()}
        flagged = {(r.k, r.i): r.p for r in previous_row(df, ["k"], ["i"], ["i"], seg, "p", where=F.col("flag")).collect()}
        for k, items in series.items():
            for n, (i, v, _) in enumerate(items):
                before = items[:n]
                assert numbered[k, i] == n + 1
                assert totals[k, i] == ((sum(b[1] for b in before), max(b[1] for b in before)) if before else (None, None))
                assert (prev[k, i].v if prev[k, i] else None) == (before[-1][1] if before else None)
                marked = [b[0] for b in before if b[2]]
                assert (flagged[k, i].i if flagged[k, i] else None) == (marked[-1] if marked else None)


def test_trailing_mean_crosses_segments(spark):
    df = spark.createDataFrame([("k", i, float(i * i)) for i in range(1, 30)], "k string, i long, v double")
    got = {r.i: r.m for r in trailing(df, ["k"], "i", "v", 4, segment_rows=5, out="m").collect()}
    assert got == {i: statistics.mean([float(j * j) for j in range(max(1, i - 3), i + 1)]) for i in range(1, 30)}


def test_monotone_stamps_name_the_first_bad_index(spark):
    rows = [("f", i, i if i != 20 else 19) for i in range(50)] + [("g", i, i) for i in range(50)] + [("h", 0, 1), ("h", 1, None)]
    df = spark.createDataFrame(rows, "file string, index long, dts long")
    for size in (3, 20, 1000):
        out = {r.file: r.bad_index for r in sq.strictly_increasing(df, ["file"], "index", "dts", size).collect()}
        assert out == {"f": 20, "g": None, "h": 1}


def test_scalar_values(spark):
    rate = one(spark, sc.auto_bitrate(F.lit(4_000_000), F.lit(1280), F.lit(720), F.lit(2560), F.lit(1440), F.lit(24.0), F.lit(24.0)))
    assert rate.bitrate == int(4e6 * 4**0.6) and (rate.pixel_ratio, rate.fps_ratio) == (4.0, 1.0)
    delta = one(spark, sc.bitrate_delta(F.lit(28.0), F.lit(35.0)))
    assert abs(delta - 0.2) < 1e-12 and one(spark, sc.bitrate_matches(F.lit(28.0), F.lit(35.0), F.lit(0.1))) is False
    assert one(spark, sc.rational_equal(F.lit("24000/1001"), F.lit("48000/2002"))) is True
    assert one(spark, sc.rational_equal(F.lit("23.976"), F.lit("24000/1001"))) is False
    assert (one(spark, sc.gop_frames(F.lit("5/2"))), one(spark, sc.gop_frames_contract(F.lit("5/2")))) == (3, 2)
    assert one(spark, sc.rational(F.lit("25/0")))["value"] == 0.0 and one(spark, sc.rational(F.lit("junk"))) is None


def test_fixed_decimals_equal_python(spark):
    rng = random.Random(2)
    values = [0.5, 1.5, 2.5, 25.8125, 2.675, -2.675, -0.125, 1e9 + 0.5, 0.0, 1234567.8950] + [rng.uniform(-1e4, 1e4) for _ in range(300)] + [rng.randrange(10**6) / 1000 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits, sign in ((0, False), (1, False), (2, True), (3, False)):
        got = df.select("v", sc.fixed(F.col("v"), digits, sign).alias("t")).collect()
        assert all(float(r.t) == float(f"{r.v:.{digits}f}") and len(r.t) == len(f"{r.v:{'+' if sign else ''}.{digits}f}") for r in got if r.v)


def test_paths_stay_inside(spark):
    redact = lambda v: one(spark, R.redact_path(F.lit(v), "/srv/data"))
    assert redact("/srv/data/a/b.mp4") == "a/b.mp4" and redact("/srv/data/../etc/key") == "external/key"
    assert redact("/srv/database/x") == "external/x" and redact("-i") == "-i" and redact("/srv/data/") == "."


def test_near_constant_values_are_refined(spark):
    # A million distinct values between 99 and 100, and a group whose values differ in their last bits.
    near = spark.range(1_000_000).select(F.lit("near").alias("k"), (99 + F.col("id") / 1_000_000).alias("v"))
    base = np.float64(1.7e9)
    bits = base + np.spacing(base) * np.arange(5000)
    last = spark.createDataFrame([("bits", float(x)) for x in bits], "k string, v double")
    wanted = {"lo": ("v", 0.001), "m": ("v", 0.5), "p": ("v", 0.99)}
    out = {r.k: r for r in exact_quantiles(near.unionByName(last), ["k"], wanted).collect()}
    values = {"near": 99 + np.arange(1_000_000) / 1_000_000, "bits": bits}
    for key, found in values.items():
        for name, (_, q) in wanted.items():
            assert np.isclose(out[key][name], np.quantile(found, q), rtol=1e-15, atol=0)


def test_no_value_is_shuffled(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit(1).alias("k"), (99 + F.col("id") / 200_000).alias("v"))
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    exact_quantiles(df, ["k"], {"m": ("v", 0.5)}).collect()
    moved = [records for stage, records in stages().items() if stage not in before]
    # Bucket counts only: at most one refinement per task, never the values.
    assert 0 < max(moved) <= 4 * 4096


def test_first_rows_of_any_count(spark):
    rng = random.Random(3)
    rows = [("hot", n, rng.randint(0, 5)) for n in rng.sample(range(20_000), 20_000)] + [("few", n, 0) for n in range(3)] + [(None, n, n) for n in (2, None, 1)]
    df = spark.createDataFrame(rows, "k string, n long, v long").coalesce(1)
    for count in (1, 5000):
        kept = sq.limit_frames(df, ["k"], ["n"], count, 1000)
        for key in ("hot", "few", None):
            mine = sorted((n is not None, n or 0) for k, n, _ in rows if k == key)[:count]
            assert sorted((r.n is not None, r.n or 0) for r in kept.collect() if r.k == key) == mine
        best = sg.best_rows(df, ["k"], [F.desc("v"), F.col("n")], count)
        got = {}
        for r in best.collect():
            got.setdefault(r.k, []).append((r["rank"], r.v, r.n))
        for key in ("hot", "few"):
            mine = sorted(((-v, n) for k, n, v in rows if k == key))[:count]
            assert sorted(got[key]) == [(i + 1, -v, n) for i, (v, n) in enumerate(mine)]


def test_decline_across_segments(spark):
    rng = random.Random(9)
    rates = [rng.choice([80.0, 99.5, 100.0, None]) for _ in range(60)]
    rows = [("s", n + 1, v) for n, v in enumerate(rates)]
    df = spark.createDataFrame(rows, "k string, num_streams int, median_fps double")
    got = {r.num_streams: (r.position, r.declined) for r in sr.confirmed_decline(df, ["k"], 0.01, 3, segment_settings=7).collect()}
    for n in range(60):
        known = [v for v in rates[:n + 1] if v is not None]
        recent = [v for v in rates[max(0, n - 2):n + 1] if v is not None]
        declined = max(recent) < max(known) * 0.99 if known and recent else None
        assert got[n + 1] == (n + 1, False if n < 3 else declined)
