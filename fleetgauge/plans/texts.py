"""Log and probe text queries over whole documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import text as tx
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query

c = F.col


@query("S05_explode_packets", """WITH o AS (SELECT o_orderkey, o_custkey, unnest(range(0, o_custkey % 5)) AS i FROM orders)
SELECT o_orderkey, CAST(i AS INTEGER) AS index, CAST(i * 512 AS VARCHAR) AS pts, CASE WHEN i <> 3 THEN CAST(i * 512 - o_custkey % 7 AS VARCHAR) END AS dts, CASE WHEN i = 0 THEN 'K__' ELSE '___' END AS flags FROM o""")
def _s05(t):
    # A probe document per order with up to four packets; some documents hold none.
    packet = lambda i: F.struct(
        (i * 512).cast("string").alias("pts"), F.when(i != 3, (i * 512 - c("o_custkey") % 7).cast("string")).alias("dts"),
        F.when(i == 0, "K__").otherwise("___").alias("flags"))
    slots = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("o_custkey") % 5)
    docs = t.orders.select("o_orderkey", F.to_json(F.struct(F.transform(slots, packet).alias("packets"))).alias("probe"))
    return tx.explode_packets(docs, "probe")


@query("S07_parse_metric_log", """SELECT doc_id, doc_id % 4 > 0 AS psnr_found, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 = 1 END AS exact, CASE WHEN doc_id % 4 > 1 THEN n_chars / 100.0 END AS psnr_db, CASE WHEN doc_id % 3 > 0 THEN 0.9 END AS ssim FROM documents""", ssim="DOUBLE")
def _s07(t):
    slot = c("doc_id") % 4
    last = F.when(slot == 1, "inf").when(slot > 1, F.format_string("%.2f", c("n_chars") / 100.0))
    log = F.concat(c("text"), F.when(slot > 0, F.concat(F.lit("\nPSNR y:1 average:31.5 min:2\nx average:"), last, F.lit(" max:9"))).otherwise(""))
    ssim = F.concat(c("text"), F.when(c("doc_id") % 3 > 0, "\nSSIM Y:0.1 All:0.5 (3)\nSSIM All:0.9 (10)").otherwise(" Ball:3"))
    found = t.documents.select("doc_id", tx.parse_metric_log(log, "psnr").alias("p"), tx.parse_metric_log(ssim, "ssim").alias("s"))
    return found.select("doc_id", c("p.found").alias("psnr_found"), c("p.exact").alias("exact"), c("p.value").alias("psnr_db"), c("s.value").alias("ssim"))


@query("S08_parse_throughput_log", f"""SELECT doc_id, n_chars / 10.0 AS throughput_qps, CASE WHEN doc_id % 3 > 0 THEN doc_id / 8.0 END AS latency_median_ms, CASE WHEN doc_id % 3 > 0 THEN doc_id / 4.0 END AS latency_p95_ms,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 7.5 END AS gpu_compute_median_ms, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 > 0 THEN 9.25 END AS gpu_compute_p95_ms,
 {errors_sql(('no latency_median_ms', 'doc_id % 3 = 0'), ('no latency_p95_ms', 'doc_id % 3 = 0'), ('no gpu_compute_median_ms', 'doc_id % 3 = 0'), ('no gpu_compute_p95_ms', 'doc_id % 3 = 0 OR doc_id % 5 = 0'))} AS errors FROM documents""", gpu_compute_median_ms="DOUBLE", gpu_compute_p95_ms="DOUBLE")
def _s08(t):
    num = lambda v, d: F.format_string(f"%.{d}f", v)
    log = F.concat(
        c("text"), F.lit("\n[I] Throughput: "), num(c("n_chars") / 10.0, 1), F.lit(" qps\n"),
        F.when(c("doc_id") % 3 > 0, F.concat(
            F.lit("[I] Latency: min = 1 ms, max = 2 ms,\n median = "), num(c("doc_id") / 8.0, 3), F.lit(" ms, percentile(95%) = "), num(c("doc_id") / 4.0, 2), F.lit(" ms\n"),
            F.lit("[I] GPU Compute Time: mean = 1 ms, median = 7.5 ms"), F.when(c("doc_id") % 5 > 0, ", percentile(95%) = 9.25 ms").otherwise(""))).otherwise(""))
    out = tx.parse_throughput_log(t.documents.select("doc_id", log.alias("log")), "log").drop("log")
    return out.select("doc_id", *tx.THROUGHPUT_PATTERNS, joined())


@query("S17_parse_level_log", f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '-inf'::DOUBLE ELSE -(n_chars % 900) / 10.0 END AS mean, CASE WHEN doc_id % 11 > 0 THEN -1.5 END AS peak FROM documents)
SELECT doc_id, CASE WHEN mean = '-inf'::DOUBLE THEN -999 ELSE mean END AS mean_dbfs, peak AS peak_dbfs, {errors_sql(('levels are missing', 'mean IS NULL OR peak IS NULL'), ('mean level is below -60', 'mean < -60'))} AS errors FROM v""", peak_dbfs="DOUBLE")
def _s17(t):
    mean = F.when(c("doc_id") % 5 == 0, "-inf").otherwise(F.format_string("-%.1f", (c("n_chars") % 900) / 10.0))
    log = F.concat(
        c("text"), F.lit("\n mean_volume: -3.0 dB"), F.when(c("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("\n[x] mean_volume:   "), mean, F.lit(" dB"))),
        F.when(c("doc_id") % 11 > 0, "\n[x] max_volume: -1.5 dB").otherwise(""))
    plain = F.when(c("doc_id") % 7 == 0, F.replace(log, F.lit("mean_volume: -3.0 dB"), F.lit(""))).otherwise(log)
    out = tx.parse_level_log(t.documents.select("doc_id", plain.alias("log")), "log", -60.0)
    quiet = F.when(c("mean_dbfs") == float("-inf"), -999.0).otherwise(c("mean_dbfs"))
    return out.select("doc_id", quiet.alias("mean_dbfs"), "peak_dbfs", joined())


@query("S18_parse_prefixed_pairs", f"""SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) AS "ULOW", CASE WHEN doc_id % 6 > 0 THEN CAST(n_chars % 100 + 20 AS DOUBLE) END AS "UHIGH", CASE WHEN doc_id % 4 > 0 THEN 16.5 END AS "VLOW", 240.0 AS "VHIGH",
 {errors_sql(('invalid value', 'doc_id % 4 = 0'), ('missing fields: UHIGH', 'doc_id % 6 = 0'))} AS errors FROM documents""", VLOW="DOUBLE", VHIGH="DOUBLE")
def _s18(t):
    names = ["ULOW", "UHIGH", "VLOW", "VHIGH"]
    p = "lavfi.signalstats."
    pair = lambda n, v: F.concat(F.lit(f"\n{p}{n}="), v)
    log = F.concat(
        c("text"), pair("ULOW", F.lit("1")), pair("ULOW", (c("n_chars") % 100).cast("string")),
        F.when(c("doc_id") % 6 > 0, pair("UHIGH", (c("n_chars") % 100 + 20).cast("string"))).otherwise(""),
        pair("VLOW", F.when(c("doc_id") % 4 > 0, "16.5").otherwise("low")), pair("VHIGH", F.lit("240")), pair("SATMAX", F.lit("3")), F.lit("\n"))
    out = tx.parse_prefixed_pairs(t.documents.select("doc_id", log.alias("log")), "log", p, names)
    return out.select("doc_id", *names, joined())


@query("A35_log_line_count", r"""WITH l AS (SELECT doc_id, n_chars, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents),
n AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '[^\s\x{a0}\x{3000}\x{2000}-\x{200a}]')) AS lines FROM l GROUP BY 1)
SELECT doc_id, lines, CASE WHEN lines <> doc_id % 10 THEN 'compared frames differ from expected frames' ELSE '' END AS errors FROM n""")
def _a35(t):
    lines = tx.filled_lines(c("text"))
    return t.documents.select(
        "doc_id", lines.cast("long").alias("lines"), F.array_join(tx.line_count_errors(lines, c("doc_id") % 10), "; ").alias("errors"))
