"""Sequence queries: a customer's orders and a conversation's turns are ordered streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import sequence as sq
from fleetgauge.operators.segments import by_width
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import micros, query, rounded
from fleetgauge.plans.stats import FRAMES, frames

c = F.col
YEAR_US = 365 * 86_400 * 1_000_000


@query("W01_strictly_increasing", f"""WITH {FRAMES}, v AS (SELECT run, frame, CASE WHEN extra > 0 THEN frame * 20000000 + cents END AS pts FROM frames), l AS (SELECT *, lag(pts) OVER (PARTITION BY run ORDER BY frame) AS prev FROM v)
SELECT run, min(frame) FILTER (pts IS NULL OR pts <= prev) AS bad_index, min(frame) FILTER (pts IS NULL OR pts <= prev) IS NULL AS monotonic FROM l GROUP BY 1""")
def _w01(t):
    data = frames(t).withColumn("pts", F.when(c("extra") > 0, c("frame") * 20_000_000 + c("cents")))
    return sq.strictly_increasing(data, ["run"], "frame", "pts", segment_rows=8)


@query("W02_keyframe_gaps", f"""WITH {FRAMES} SELECT run, frame, frame - lag(frame) OVER (PARTITION BY run ORDER BY frame) AS gap FROM frames WHERE extra < 2""")
def _w02(t):
    return sq.keyframe_gaps(frames(t), ["run"], "frame", c("extra") < 2, segment_rows=8)


@query("W03_contiguous", """SELECT conv_id, count(*) AS rows, min(turn + 1 + conv_id % 2) = 1 AND max(turn + 1 + conv_id % 2) = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1""")
def _w03(t):
    data = t.conversations.select("conv_id", (c("turn") + 1 + c("conv_id") % 2).alias("attempt"))
    return sq.contiguous(data, ["conv_id"], "attempt")


@query("W03b_complete_rounds", """WITH m AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, count(*) FILTER (m = 1) AS complete_rounds, max(l_linenumber) = count(*) FILTER (m = 1) AS contiguous FROM m GROUP BY 1""")
def _w03b(t):
    return sq.complete_rounds(t.lineitem, ["l_orderkey"], "l_linenumber", "l_returnflag", 1)


@query("W04_idle_gaps", f"""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS f FROM orders),
g AS (SELECT *, (s - lag(f) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey)) / 1e6 AS gap FROM o)
SELECT o_custkey, o_orderkey, round(gap, 6) AS idle_seconds, {errors_sql(('finishes before it starts', 'f < s'), ('did not observe the required 3600s idle interval', 'gap < 3600 - 0.05'))} AS errors FROM g""")
def _w04(t):
    sign = F.when(c("o_orderkey") % 50 == 0, -1).otherwise(1)
    data = t.orders.select(
        "o_custkey", "o_orderkey", micros("o_orderdate").alias("s"),
        (micros("o_orderdate") + sign * F.round(c("o_totalprice") * 100).cast("long") * 1_000_000).alias("f"))
    out = sq.idle_gaps(data, ["o_custkey"], ["s", "o_orderkey"], "s", "f", 3600.0, by_width(c("s"), YEAR_US))
    return rounded(out.select("o_custkey", "o_orderkey", "idle_seconds", joined()))


ROTATION = "rot(sequence_index, round_index, implementation) AS (VALUES (1, 1, 'a'), (2, 1, 'b'), (3, 1, 'c'), (4, 2, 'b'), (5, 2, 'c'), (6, 2, 'a'), (7, 3, 'c'), (8, 3, 'a'), (9, 3, 'b'), (10, 4, 'c'), (11, 4, 'b'), (12, 4, 'a'), (13, 5, 'a'), (14, 5, 'c'), (15, 5, 'b'))"


@query("W14_rotation_order", f"WITH {ROTATION} SELECT c_custkey, sequence_index, round_index, implementation FROM customer, rot")
def _w14(t):
    return sq.rotation_order(t.customer.select("c_custkey"), ["a", "b", "c"], 5)


@query("J03_align_sequence", f"""WITH {ROTATION}, a AS (SELECT o_custkey AS campaign, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey % 3 AS i, o_orderkey % 5 + 1 AS r FROM orders),
e AS (SELECT c_custkey AS campaign, sequence_index AS position, round_index AS r, implementation AS i FROM customer, rot)
SELECT coalesce(a.campaign, e.campaign) AS campaign, coalesce(a.position, e.position) AS position, {errors_sql(('missing step', 'a.position IS NULL'), ('too many steps', 'e.position IS NULL'), ('changed round_index', 'a.r <> e.r'), ('changed implementation', "substr('abc', CAST(a.i + 1 AS INTEGER), 1) <> e.i"))} AS errors
FROM a FULL JOIN e ON a.campaign = e.campaign AND a.position = e.position""")
def _j03(t):
    slot = c("o_orderkey") % 3
    actual = t.orders.select(
        c("o_custkey").alias("campaign"), micros("o_orderdate").alias("us"), "o_orderkey",
        F.when(slot == 0, "a").when(slot == 1, "b").otherwise("c").alias("implementation"), (c("o_orderkey") % 5 + 1).cast("int").alias("round_index"))
    expected = sq.rotation_order(t.customer.select(c("c_custkey").alias("campaign")), ["a", "b", "c"], 5).withColumnRenamed("sequence_index", "position")
    out = sq.align_sequence(actual, expected, ["campaign"], ["us", "o_orderkey"], by_width(c("us"), YEAR_US), "position", ["round_index", "implementation"])
    return out.select("campaign", "position", joined())


@query("W17_resample_drop", f"""WITH {FRAMES}, s AS (SELECT *, CAST(floor(frame / 24.0 * 10.0 + 0.5) AS BIGINT) AS slot FROM frames) SELECT run, slot, max(frame) AS frame FROM s GROUP BY 1, 2""")
def _w17(t):
    data = frames(t).select("run", "frame")
    return sq.resample_drop(data, ["run"], c("frame") / 24.0, 24.0, 10.0)


@query("W18_limit_frames", f"WITH {FRAMES} SELECT run, frame, cents FROM frames WHERE frame < 3")
def _w18(t):
    return sq.limit_frames(frames(t), ["run"], ["frame"], 3).select("run", "frame", "cents")
