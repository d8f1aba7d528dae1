"""Streaming queries: the tables are read as streams and driven to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.plans.registry import query
from fleetgauge.plans.telemetry import REASONS
from fleetgauge.streaming import live

c = F.col


def stream(t, name):
    batch = getattr(t, name)
    source = t.spark.readStream.schema(batch.schema).parquet(f"{t.folder}/{name}.parquet*")
    return source.withColumn("ts", c("ts").cast("timestamp")) if "ts" in batch.columns else source


def us(name):
    return F.unix_micros(name).alias(name)


@query("X01_stream_telemetry_rollup", f"""WITH g AS (SELECT user_id AS run_id, epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS samples, sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100 AS mean, max(value) AS peak FROM events GROUP BY 1, 2)
SELECT run_id, window_start, samples, round(mean, 6) AS mean, peak FROM g""")
def _x01(t):
    rolled = live.stream_telemetry_rollup(stream(t, "events").withColumnRenamed("user_id", "run_id"), ["run_id"], "ts", "value", "1 day", "1 hour")
    out = live.run_once(rolled, "rollup", "update", ["run_id", "window_start"])
    return out.select("run_id", us("window_start"), "samples", F.round("mean", 6).alias("mean"), "peak")


@query("X02_stream_sliding_rate", f"""WITH e AS (SELECT event_type, unnest([epoch_us(date_trunc('day', ts)), epoch_us(date_trunc('day', ts)) - 86400000000]) AS window_start FROM events),
g AS (SELECT event_type, window_start, count(*) AS frames FROM e GROUP BY 1, 2) SELECT event_type, window_start, frames, round(frames / 172800.0, 9) AS fps FROM g""")
def _x02(t):
    rated = live.stream_sliding_rate(stream(t, "events"), ["event_type"], "ts", "2 days", "1 day", 172_800.0, "1 hour")
    return live.run_once(rated, "rate", "update", ["event_type", "window_start"]).select("event_type", us("window_start"), "frames", F.round("fps", 9).alias("fps"))


@query("X03_stream_idle_sessions", f"""WITH l AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT user_id, us, sum(CASE WHEN prev IS NULL OR us - prev >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS n FROM l),
g AS (SELECT user_id, min(us) AS session_start, max(us) + 43200000000 AS session_end, count(*) AS events FROM s GROUP BY user_id, n) SELECT user_id, session_start, session_end, events FROM g""")
def _x03(t):
    # Sessions leave the state as the watermark closes them; the last open ones are closed at the end.
    closing = live.Closing(stream(t, "events").select("user_id", "ts"), "ts")
    split = live.stream_idle_sessions(closing.events, ["user_id"], "ts", "12 hours", "1 hour")
    return live.run_once(split, "sessions", "append", closing=closing).select("user_id", us("session_start"), us("session_end"), "events")


@query("X04_stream_first_last_marker", "SELECT user_id AS run_id, min(epoch_us(ts)) AS first_frame, max(epoch_us(ts)) AS last_frame, count(*) AS frames FROM events GROUP BY 1")
def _x04(t):
    source = stream(t, "events").select(c("user_id").alias("run_id"), F.unix_micros("ts").alias("us"), "ts")
    parts = live.stream_first_last_marker(source, ["run_id"], "us", "ts", "7 days", "1 hour")
    return live.merge_markers(live.run_once(parts, "markers", "update", ["run_id", "part_start"]), ["run_id"])


@query("X05_stream_sequence_guard", """SELECT CAST(conv_id AS VARCHAR) AS key, count(*) AS attempts, min(turn) + conv_id % 3 = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous,
 count(*) FILTER (role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS unexpected_steps FROM conversations GROUP BY conv_id""")
def _x05(t):
    source = stream(t, "conversations").withColumn("attempt", c("turn") + 1 + c("conv_id") % 3)
    expected = c("role") == F.when(c("turn") % 2 == 0, "user").otherwise("assistant")
    # Two indexes to a range, so that campaigns of more are kept by several states.
    parts = live.run_once(live.stream_sequence_guard(source, "conv_id", "attempt", expected, 2), "guard", "update", ["key", "part"])
    return live.merge_guard(parts)


@query("X06_stream_throttle_alerts", "SELECT event_id, 'hw_slowdown' AS invalid_reasons FROM events WHERE event_type = 'signup'")
def _x06(t):
    reasons = F.array().cast("array<string>")
    for event, names in REASONS.items():
        if names:
            reasons = F.when(c("event_type") == event, F.array(*[F.lit(n) for n in names])).otherwise(reasons)
    alerts = live.stream_throttle_alerts(stream(t, "events").withColumn("throttle_reasons", reasons))
    return live.run_once(alerts.select("event_id", F.array_join("invalid_reasons", ",").alias("invalid_reasons")), "alerts")


@query("X07_stream_dedup_events", "SELECT event_id, user_id FROM events")
def _x07(t):
    twice = stream(t, "events").union(stream(t, "events"))
    unique = live.stream_dedup_events(twice, ["event_id"], "ts", "1 hour")
    return live.run_once(unique.select("event_id", "user_id"), "dedup")


@query("X08_stream_extension_trigger", """WITH r AS (SELECT o_custkey, o_orderkey % 5 + 1 AS i, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, count(v) FILTER (i <= 3) AS runs, CASE WHEN count(v) FILTER (i <= 3) = 3 THEN (max(v) FILTER (i <= 3) - min(v) FILTER (i <= 3)) / median(v) FILTER (i <= 3) END AS s FROM r GROUP BY 1)
SELECT o_custkey, runs, round(s, 8) AS relative_spread, coalesce(s > 0.5, false) AS extend FROM g""")
def _x08(t):
    source = stream(t, "orders").select("o_custkey", (c("o_orderkey") % 5 + 1).alias("run_index"), "o_totalprice", c("o_orderdate").cast("timestamp").alias("ts"))
    parts = live.stream_extension_trigger(source, ["o_custkey"], "run_index", "o_totalprice", 3, "ts", "365 days", "1 day")
    out = live.extension_verdict(live.run_once(parts, "trigger", "update", ["o_custkey", "part_start"]), ["o_custkey"], 3, 0.5)
    return out.withColumn("relative_spread", F.round("relative_spread", 8))
