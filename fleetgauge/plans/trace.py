"""Interval queries: events as intervals of a trace (one trace per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import intervals as iv
from fleetgauge.plans.registry import micros, query, rounded

# Segment width of the interval operators: five days of microseconds.
WIDTH = 5 * 86_400 * 1_000_000

# An event lasts value * 1e8 microseconds; the loop is the middle eight tenths of the trace.
SPANS = """
spans AS (
  SELECT user_id AS trace_id, event_type, value, props, event_id, epoch_us(ts) AS "start",
         epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 1000000 AS "end",
         CAST(round(value * 100) AS BIGINT) AS bytes
  FROM events)"""
WINDOWS = """
wins AS (
  SELECT trace_id, lo + (hi - lo) // 10 AS win_start, hi - (hi - lo) // 10 AS win_end
  FROM (SELECT trace_id, min("start") AS lo, max("start") AS hi FROM spans GROUP BY trace_id)
  WHERE hi > lo)"""


def merged(name: str, source: str, keys: str) -> str:
    return f"""
{name}_f AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end"
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source} WHERE "end" > "start"),
{name}_g AS (SELECT *, sum(CASE WHEN pm IS NULL OR "start" > pm THEN 1 ELSE 0 END) OVER (
    PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_f),
{name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM {name}_g GROUP BY {keys}, grp)"""


def spans(t):
    whole = F.round(F.col("value") * 100).cast("long")
    return t.events.select(
        F.col("user_id").alias("trace_id"), "event_type", "value", "props", "event_id",
        micros().alias("start"), (micros() + whole * 1_000_000).alias("end"), whole.alias("bytes"),
    )


def windows(t):
    lo, hi = F.col("lo"), F.col("hi")
    tenth = F.floor((hi - lo) / 10)
    return (
        t.events.groupBy(F.col("user_id").alias("trace_id"))
        .agg(F.min(micros()).alias("lo"), F.max(micros()).alias("hi"))
        .filter(hi > lo)
        .select("trace_id", (lo + tenth).cast("long").alias("win_start"), (hi - tenth).cast("long").alias("win_end"))
    )


@query("W06_merge_intervals", f"""WITH {SPANS}, {merged('m', 'spans', 'trace_id')}
SELECT trace_id, "start", "end" FROM m""")
def _merge(t):
    return iv.merge_intervals(spans(t), ["trace_id"], WIDTH)


SWEEP_SQL = f"""WITH {SPANS},
a AS (SELECT * FROM spans WHERE event_type IN ('click', 'view')),
b AS (SELECT * FROM spans WHERE event_type NOT IN ('click', 'view')),
{merged('ma', 'a', 'trace_id')}, {merged('mb', 'b', 'trace_id')},
ids AS (SELECT DISTINCT trace_id FROM spans),
ov AS (SELECT ma.trace_id, sum(least(ma."end", mb."end") - greatest(ma."start", mb."start")) AS overlap
  FROM ma JOIN mb ON ma.trace_id = mb.trace_id AND ma."start" < mb."end" AND mb."start" < ma."end" GROUP BY 1),
ba AS (SELECT trace_id, sum("end" - "start") AS busy FROM ma GROUP BY 1),
bb AS (SELECT trace_id, sum("end" - "start") AS busy FROM mb GROUP BY 1)
"""


@query("W06b_concurrency_sweep", SWEEP_SQL + """
SELECT ids.trace_id, CAST(coalesce(ba.busy, 0) AS BIGINT) AS busy_a, CAST(coalesce(bb.busy, 0) AS BIGINT) AS busy_b,
       CAST(coalesce(ov.overlap, 0) AS BIGINT) AS overlap
FROM ids LEFT JOIN ba USING (trace_id) LEFT JOIN bb USING (trace_id) LEFT JOIN ov USING (trace_id)""")
def _sweep(t):
    return iv.concurrency_sweep(
        spans(t), ["trace_id"], F.col("event_type").isin("click", "view"), WIDTH
    )


@query("J06_interval_overlap", SWEEP_SQL + """
SELECT ids.trace_id, CAST(coalesce(ov.overlap, 0) AS BIGINT) AS overlap
FROM ids LEFT JOIN ov USING (trace_id)""")
def _overlap(t):
    data = spans(t)
    side = F.col("event_type").isin("click", "view")
    return iv.interval_overlap(data.filter(side), data.filter(~side), ["trace_id"], WIDTH)


CLIP = """
cut AS (SELECT s.trace_id, s.event_type, s.bytes, w.win_start, w.win_end,
    greatest(s."start", w.win_start) AS "start", least(s."end", w.win_end) AS "end"
  FROM spans s JOIN wins w USING (trace_id) WHERE s."end" > w.win_start AND s."start" < w.win_end)"""


@query("A37_interval_coverage", f"""WITH {SPANS}, {WINDOWS}, {CLIP}, {merged('m', 'cut', 'trace_id')}
SELECT w.trace_id, CAST(coalesce(b.busy, 0) AS BIGINT) AS busy,
       round(coalesce(b.busy, 0) / (w.win_end - w.win_start) * 100.0, 6) AS coverage_percent
FROM wins w LEFT JOIN (SELECT trace_id, sum("end" - "start") AS busy FROM m GROUP BY 1) b USING (trace_id)""")
def _coverage(t):
    return rounded(iv.interval_coverage(spans(t), windows(t), ["trace_id"], WIDTH))


COPIES = """
copies AS (SELECT trace_id, event_type, bytes, "start", "end" FROM spans),
moved AS (SELECT c.trace_id, c.event_type,
   count(*) FILTER (c."end" > w.win_start AND c."start" < w.win_end) AS copies,
   coalesce(sum(c.bytes) FILTER (c."end" > w.win_start AND c."start" < w.win_end), 0) AS bytes,
   coalesce(sum(least(c."end", w.win_end) - greatest(c."start", w.win_start))
     FILTER (c."end" > w.win_start AND c."start" < w.win_end), 0) AS busy,
   count(*) FILTER (c."end" <= w.win_start) AS startup_copies,
   coalesce(sum(c.bytes) FILTER (c."end" <= w.win_start), 0) AS startup_bytes
 FROM copies c JOIN wins w USING (trace_id) GROUP BY 1, 2)"""


@query("A36_copy_statistics", f"""WITH {SPANS}, {WINDOWS}, {COPIES}
SELECT trace_id, event_type AS direction, copies, CAST(bytes AS BIGINT) AS bytes,
  round(bytes / 120 / 1048576.0, 9) AS mib_per_frame, round(busy / 120 / 1000000.0, 6) AS ms_per_frame,
  startup_copies, CAST(startup_bytes AS BIGINT) AS startup_bytes FROM moved""")
def _copies(t):
    copies = spans(t).select("trace_id", F.col("event_type").alias("direction"), "bytes", "start", "end")
    stats = iv.copy_statistics(copies, windows(t), ["trace_id"], "direction", "bytes", F.lit(120))
    return stats.withColumns(
        {"mib_per_frame": F.round("mib_per_frame", 9), "ms_per_frame": F.round("ms_per_frame", 6)}
    )


@query("A38_trace_findings", f"""WITH {SPANS}, {WINDOWS}, {CLIP}, {COPIES},
k AS (SELECT * FROM cut WHERE event_type IN ('view', 'signup')),
d AS (SELECT * FROM cut WHERE event_type = 'click'), e AS (SELECT * FROM cut WHERE event_type = 'error'),
{merged('mk', 'k', 'trace_id')}, {merged('md', 'd', 'trace_id')}, {merged('me', 'e', 'trace_id')},
kb AS (SELECT trace_id, sum("end" - "start") AS busy FROM mk GROUP BY 1),
db AS (SELECT trace_id, sum("end" - "start") AS busy FROM md GROUP BY 1),
eb AS (SELECT trace_id, sum("end" - "start") AS busy FROM me GROUP BY 1),
dk AS (SELECT x.trace_id, sum(least(x."end", y."end") - greatest(x."start", y."start")) AS ov FROM md x JOIN mk y
  ON x.trace_id = y.trace_id AND x."start" < y."end" AND y."start" < x."end" GROUP BY 1),
ek AS (SELECT x.trace_id, sum(least(x."end", y."end") - greatest(x."start", y."start")) AS ov FROM me x JOIN mk y
  ON x.trace_id = y.trace_id AND x."start" < y."end" AND y."start" < x."end" GROUP BY 1),
h AS (SELECT * FROM moved WHERE event_type = 'click'), u AS (SELECT * FROM moved WHERE event_type = 'purchase'),
g AS (SELECT * FROM moved WHERE event_type = 'view')
SELECT w.trace_id, round((w.win_end - w.win_start) / 1e9, 6) AS frame_loop_sec,
  round(coalesce(kb.busy, 0) / (w.win_end - w.win_start) * 100.0, 6) AS kernel_coverage_percent,
  round(CASE WHEN db.busy > 0 THEN coalesce(dk.ov, 0) / db.busy * 100.0 END, 6) AS decode_overlap_percent,
  round(CASE WHEN eb.busy > 0 THEN coalesce(ek.ov, 0) / eb.busy * 100.0 END, 6) AS encode_overlap_percent,
  coalesce(h.startup_copies, 0) AS startup_h2d_copies, round(coalesce(h.startup_bytes, 0) / 1048576.0, 6) AS startup_h2d_mib,
  coalesce(h.copies, 0) AS loop_h2d_copies, round(coalesce(h.bytes, 0) / 1048576.0, 6) AS loop_h2d_mib,
  coalesce(u.copies, 0) AS loop_d2h_copies, round(coalesce(u.bytes, 0) / 1048576.0, 6) AS loop_d2h_mib,
  coalesce(g.copies, 0) AS loop_d2d_copies,
  round(coalesce(g.bytes, 0) / 120 / 1048576.0, 6) AS d2d_mib_per_frame,
  round(coalesce(g.busy, 0) / 120 / 1000000.0, 6) AS d2d_ms_per_frame,
  coalesce(h.bytes, 0) + coalesce(u.bytes, 0) > 0 AS loop_host_copies
FROM wins w LEFT JOIN kb USING (trace_id) LEFT JOIN db USING (trace_id) LEFT JOIN eb USING (trace_id)
LEFT JOIN dk USING (trace_id) LEFT JOIN ek USING (trace_id)
LEFT JOIN h USING (trace_id) LEFT JOIN u USING (trace_id) LEFT JOIN g USING (trace_id)""")
def _findings(t):
    data = spans(t)
    kernels = data.filter(F.col("event_type").isin("view", "signup"))
    video = data.filter(F.col("event_type").isin("click", "error")).withColumn(
        "engine", F.when(F.col("event_type") == "click", "decode").otherwise("encode")
    )
    direction = (
        F.when(F.col("event_type") == "click", "h2d")
        .when(F.col("event_type") == "purchase", "d2h")
        .when(F.col("event_type") == "view", "d2d")
    )
    copies = data.withColumn("direction", direction).filter(F.col("direction").isNotNull())
    found = iv.trace_findings(
        windows(t), kernels, video, copies.select("trace_id", "direction", "bytes", "start", "end"),
        ["trace_id"], WIDTH, F.lit(120),
    )
    return rounded(found)


@query("A54_trace_name_summary", """
SELECT user_id AS trace_id, event_type AS name, count(*) AS calls, round(sum(value), 2) AS total,
  round(avg(value), 8) AS mean, min(value) AS shortest, max(value) AS longest FROM events GROUP BY 1, 2""")
def _names(t):
    data = t.events.select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), "value")
    found = iv.trace_name_summary(data, ["trace_id"], "name", F.col("value"))
    return found.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 8)})


# Four traces, each with a dictionary of its own whose ids mean something else in the next one.
@query("J07_resolve_names", """
WITH d AS (SELECT k AS trace_id, n_nationkey + 3 * k AS id, n_name || '-' || k AS value FROM nation, unnest(range(4)) AS r(k))
SELECT e.event_id, coalesce(d.value, e.event_type) AS label FROM events e
LEFT JOIN d ON d.trace_id = e.user_id % 4 AND d.id = CAST(json_extract(e.props, '$.k') AS BIGINT)""")
def _resolve(t):
    named = t.events.select(
        "event_id", "event_type", (F.col("user_id") % 4).alias("trace_id"), F.get_json_object("props", "$.k").cast("long").alias("text_id"))
    strings = t.nation.withColumn("trace_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select(
        "trace_id", (F.col("n_nationkey") + 3 * F.col("trace_id")).alias("id"), F.concat_ws("-", "n_name", "trace_id").alias("value"))
    return iv.resolve_names(named, strings, "text_id", "event_type", keys=["trace_id"]).select("event_id", "label")


# Three traces with shifted ids; in the last one the name occurs twice and so means nothing.
@query("J08_enum_filter", """
WITH d AS (SELECT k AS trace_id, (n_nationkey + k) % 25 AS id, CASE WHEN k = 2 AND n_nationkey = 8 THEN 'NATION_7' ELSE n_name END AS name FROM nation, unnest(range(3)) AS r(k)),
u AS (SELECT trace_id, min(id) AS id FROM d WHERE name = 'NATION_7' GROUP BY trace_id HAVING count(*) = 1)
SELECT c.c_custkey, c.c_name FROM customer c JOIN u ON u.trace_id = c.c_custkey % 3 AND u.id = c.c_nationkey""")
def _enum(t):
    trace = F.col("trace_id")
    enum = t.nation.withColumn("trace_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).select(
        "trace_id", ((F.col("n_nationkey") + trace) % 25).alias("id"),
        F.when((trace == 2) & (F.col("n_nationkey") == 8), "NATION_7").otherwise(F.col("n_name")).alias("name"))
    facts = t.customer.withColumn("trace_id", (F.col("c_custkey") % 3).cast("long"))
    return iv.enum_filter(facts, enum, "c_nationkey", "NATION_7", ["trace_id"]).select("c_custkey", "c_name")
