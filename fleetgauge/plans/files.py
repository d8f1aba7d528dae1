"""File source and sink queries: whole tables are written below the shared folder and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetgauge.plans.manifests import MANIFEST_SQL, errors_sql, joined, manifests
from fleetgauge.plans.registry import query, rounded
from fleetgauge.plans.telemetry import SAMPLES, runs_and_samples
from fleetgauge.plans.trace import WIDTH, spans, windows
from fleetgauge.session import new_folder
from fleetgauge.sources import readers as rd
from fleetgauge.sources import schemas as sm
from fleetgauge.sources import sinks as sk
from fleetgauge.sources.files import write_files

c = F.col


@query("S01_read_run_manifests", f"""WITH {MANIFEST_SQL} SELECT k, status, product AS implementation, CAST(run_index AS INTEGER) AS round, workload_id, frames, warmup_frames, input_sha256, image_id, publishable, CAST(NULL AS VARCHAR) AS read_error FROM m
UNION ALL SELECT NULL, NULL, product, CAST(run_index AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL, 'empty file' FROM m WHERE k % 97 = 0""")
def _s01(t):
    folder = new_folder(t.spark, "manifests")
    rows = manifests(t).withColumns({"implementation": c("product"), "round": c("run_index")})
    rows.write.partitionBy("implementation", "round").json(folder)
    # Runs that crashed before their manifest had content.
    crashed = rows.filter(c("k") % 97 == 0).select(
        F.concat(F.lit("implementation="), "implementation", F.lit("/round="), "round", F.lit("/crashed-"), "k", F.lit(".json")).alias("name"), F.lit("").alias("content"))
    write_files(crashed, folder)
    back = rd.read_run_manifests(
        t.spark, f"{folder}/*/*/*.json", schema=f"k long, {sm.MANIFEST}", multi_line=False, layout=r"implementation=([^/]+)/round=(\d+)/")
    return back.select(
        "k", "status", "implementation", "round", "workload_id", c("parameters.frames").alias("frames"), c("parameters.warmup_frames").alias("warmup_frames"),
        c("assets.input.sha256").alias("input_sha256"), c("environment.image.id").alias("image_id"), c("reproducibility.publishable").alias("publishable"), "read_error")


EVENT_SQL = """
ev AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS v, o_orderkey % 7 AS a, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'open' END AS st, o_orderkey % 11 - 1 AS idle, o_totalprice - 1000 AS dur, o_orderkey % 17 > 0 AS zoned, epoch_us(o_orderdate) AS us FROM orders)"""


def events(t):
    stamp = F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(c("o_orderkey") % 17 > 0, "+01:00").otherwise("")
    k = c("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_custkey", F.when(k % 13 == 0, 2).otherwise(1).alias("schema_version"), (k % 7).cast("int").alias("attempt_index"), F.lit(1).alias("sequence_index"),
        F.lit(1).alias("round_index"), c("o_orderpriority").alias("implementation"),
        F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "failed").otherwise("open").alias("status"), F.lit(0).alias("returncode"),
        F.lit(30.0).alias("required_idle_seconds"), (k % 11 - 1).cast("double").alias("observed_idle_seconds"), F.concat(stamp, zone).alias("started_at_utc"),
        F.concat(stamp, zone).alias("finished_at_utc"), (c("o_totalprice") - 1000).alias("duration_seconds"), F.lit("a/manifest.json").alias("manifest"))


@query("S02_read_event_log", f"""WITH {EVENT_SQL} SELECT o_orderkey, CASE WHEN zoned THEN us - 3600000000 END AS started_us, {errors_sql(('unsupported schema', 'v <> 1'), ('indexes must be positive', 'a <= 0'), ('invalid status', "st = 'open'"),
 ('idle durations cannot be negative', 'idle < 0'), ('duration cannot be negative', 'dur < 0'), ('timestamps must include a timezone', 'NOT zoned'))} AS errors FROM ev""")
def _s02(t):
    folder = new_folder(t.spark, "events")
    sk.append_events(events(t), folder)
    back = rd.read_event_log(t.spark, folder, extra=", o_orderkey long, o_custkey long")
    return back.select("o_orderkey", F.unix_micros("started").alias("started_us"), joined())


@query("S10_append_events", """SELECT o_custkey, count(*) * 2 AS events, count(*) FILTER (o_orderstatus = 'F') * 2 AS completed FROM orders GROUP BY 1""")
def _s10(t):
    folder = new_folder(t.spark, "append")
    sk.append_events(events(t), folder)
    sk.append_events(events(t), folder)
    back = rd.read_event_log(t.spark, folder, extra=", o_orderkey long, o_custkey long")
    return back.groupBy("o_custkey").agg(F.count("*").alias("events"), F.count_if(c("status") == "completed").alias("completed"))


@query("S03_read_telemetry", f"""WITH {SAMPLES} SELECT CAST(run_id AS VARCHAR) AS run_id, round(t, 6) AS relative_sec, power_w, util AS gpu_utilization_percent, CASE event_type WHEN 'click' THEN 'gpu_idle' WHEN 'purchase' THEN 'sw_power_cap' WHEN 'signup' THEN 'hw_slowdown,sw_power_cap' WHEN 'error' THEN 'sync_boost' ELSE '' END AS throttle_reasons FROM samples""", gpu_utilization_percent="INTEGER")
def _s03(t):
    folder = new_folder(t.spark, "samples")
    # Absent values and an absent list are left out of the lines, as a sampler may do.
    samples = runs_and_samples(t)[1].withColumn("throttle_reasons", F.when(F.size("throttle_reasons") > 0, c("throttle_reasons")))
    samples.write.json(folder)
    back = rd.read_telemetry(t.spark, folder)
    return rounded(back.select("run_id", "relative_sec", "power_w", "gpu_utilization_percent", F.array_join("throttle_reasons", ",").alias("throttle_reasons")))


def trace_tables(t):
    """Events as the seven native trace tables; every trace numbers its strings and enums in its own way."""
    data, kind = spans(t), c("event_type")
    pick = lambda *names: data.filter(kind.isin(*names))
    loops = windows(t).select("trace_id", c("win_start").alias("start"), c("win_end").alias("end"))
    shift, even = c("trace_id") % 5, c("trace_id") % 2 == 0
    other = pick("error").select("trace_id", "start", "end", F.lit("warm-up").alias("text"), F.lit(None).cast("long").alias("textId"))
    traces = data.select("trace_id").distinct()
    rows = lambda *entries: traces.select("trace_id", F.inline(F.array(*[
        F.struct((F.lit(number) + shift).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(label).alias("label")) for number, name, label in entries])))
    return {
        "CUPTI_ACTIVITY_KIND_KERNEL": pick("view", "signup").select("trace_id", "start", "end"),
        "CUPTI_ACTIVITY_KIND_MEMCPY": pick("click", "purchase", "view").select(
            "trace_id", "start", "end", "bytes", (shift + F.when(kind == "click", 1).when(kind == "purchase", 2).otherwise(8)).alias("copyKind")),
        "GPU_VIDEO_ENGINE_WORKLOAD": pick("click", "error").select("trace_id", "start", "end", (shift + F.when(kind == "click", 1).otherwise(2)).alias("engineType")),
        "NVTX_EVENTS": loops.select(
            "trace_id", "start", "end", F.when(~even, "pipeline.frame_loop").alias("text"), F.when(even, 7 + shift).cast("long").alias("textId")).unionByName(other),
        "ENUM_CUDA_MEMCPY_OPER": rows((1, "CUDA_MEMCPY_KIND_HTOD", "h2d"), (2, "CUDA_MEMCPY_KIND_DTOH", "d2h"), (8, "CUDA_MEMCPY_KIND_DTOD", "d2d")),
        "ENUM_VIDEO_ENGINE_TYPE": rows((1, "NVDEC", "decode"), (2, "NVENC", "encode")),
        "StringIds": rows((7, "pipeline.frame_loop", ""), (8, "other", ""), (6, "another", "")).select("trace_id", "id", c("name").alias("value")),
    }


def _findings_sql() -> str:
    from fleetgauge.plans.registry import REGISTRY
    from fleetgauge.plans import trace

    return f"""WITH {trace.SPANS}, {trace.WINDOWS}, f AS ({REGISTRY["A38_trace_findings"].sql}),
tr AS (SELECT DISTINCT trace_id FROM spans WHERE event_type IN ('view', 'signup', 'error') UNION SELECT trace_id FROM wins)
SELECT tr.trace_id, CASE WHEN f.trace_id IS NULL THEN 'lacks one complete window' END AS window_error, f.* EXCLUDE (trace_id) FROM tr LEFT JOIN f ON f.trace_id = tr.trace_id"""


@query("S04_read_trace_tables", _findings_sql())
def _s04(t):
    folder = new_folder(t.spark, "trace")
    for name, table in trace_tables(t).items():
        table.write.parquet(f"{folder}/{name}")
    tables = rd.read_trace_tables(t.spark, folder)
    return rounded(rd.analyse_trace(tables, ["trace_id"], "pipeline.frame_loop", WIDTH, F.lit(120)))


@query("S06_decode_frame_tensors", """WITH el AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), s AS (SELECT vec_id, count(*) AS n, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi, vec_id % 7 > 0 AND vec_id % 11 > 0 AS good FROM el GROUP BY 1)
SELECT vec_id, CASE WHEN NOT good THEN 'size does not match float32 shape' END AS size_error, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 4 * n END AS length, CASE WHEN good THEN n END AS elements, CASE WHEN good THEN lo END AS low, CASE WHEN good THEN hi END AS high FROM s""")
def _s06(t):
    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, dtype="<f4").tobytes())

    folder, v = new_folder(t.spark, "tensors"), c("vec_id")
    # Every eleventh capture broke off before its tensor had content.
    write_files(t.embeddings.select(
        F.concat_ws("/", F.floor(v / 64).cast("string"), F.concat(v.cast("string"), F.lit(".f32"))).alias("name"),
        F.when(v % 11 > 0, packed("embedding")).alias("content")), folder)
    number = F.regexp_extract("path", r"(\d+)\.f32$", 1).cast("long")
    back = rd.read_frame_tensors(t.spark, f"{folder}/*/*.f32", F.when(number % 7 == 0, 63).otherwise(64)).withColumn("vec_id", number)
    good = c("values").isNotNull()
    return back.select(
        "vec_id", "size_error", "length", F.when(good, F.size("values")).cast("long").alias("elements"),
        F.array_min("values").cast("double").alias("low"), F.array_max("values").cast("double").alias("high"))


@query("S09_write_sorted_json", """SELECT '{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || CASE WHEN p_size > 40 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS value FROM part""")
def _s09(t):
    folder = new_folder(t.spark, "json")
    rows = t.part.select(F.when(c("p_size") <= 40, c("p_size")).alias("size"), c("p_partkey").alias("key"), c("p_brand").alias("brand"))
    sk.write_sorted_json(rows, folder, ["key"])
    return t.spark.read.text(folder)


@query("S11_create_exclusive", "SELECT c_custkey, c_name, true AS refused FROM customer")
def _s11(t):
    from pyspark.errors import AnalysisException

    folder = new_folder(t.spark, "exclusive")
    sk.create_exclusive(t.customer.select("c_custkey", "c_name"), folder)
    try:
        sk.create_exclusive(t.customer.select("c_custkey", F.lit("other").alias("c_name")), folder)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(folder).withColumn("refused", F.lit(refused))


@query("S12_publish_atomically", "SELECT s_suppkey, s_name, true AS refused FROM supplier")
def _s12(t):
    folder = new_folder(t.spark, "published")
    unnamed = ("name is missing", lambda df: df.filter(c("s_name").isNull() | (c("s_name") == "")))
    first = t.supplier.select("s_suppkey", F.lit("draft").alias("s_name"))
    sk.publish_atomically(first, folder, [unnamed])
    sk.publish_atomically(t.supplier.select("s_suppkey", "s_name"), folder, [unnamed])
    try:
        sk.publish_atomically(t.supplier.select("s_suppkey", F.lit("").alias("s_name")), folder, [unnamed])
        refused = False
    except sk.PublicationError:
        refused = True
    return sk.read_published(t.spark, folder).withColumn("refused", F.lit(refused))


@query("S13_file_digests", """WITH l AS (SELECT s_nationkey, s_suppkey, s_suppkey || '|' || s_name || chr(10) AS line FROM supplier),
n AS (SELECT 'nation=' || s_nationkey AS file, string_agg(line, '' ORDER BY s_suppkey) AS content FROM l GROUP BY s_nationkey
  UNION ALL SELECT ['', '_', '.'][r_regionkey % 3 + 1] || r_name || '.bin', CASE WHEN r_regionkey = 4 THEN '' ELSE repeat(r_name, 300000) END FROM region UNION ALL SELECT '_SUCCESS', '')
SELECT file, sha256(content) AS sha256, strlen(content) AS size_bytes, substr(file, 1, 1) IN ('_', '.') AS hidden, CAST(NULL AS VARCHAR) AS read_error FROM n""")
def _s13(t):
    folder, key = new_folder(t.spark, "artifacts"), c("r_regionkey")
    # One text file per nation by Spark, and files of odd names, no content and more than one chunk.
    lines = t.supplier.select(c("s_nationkey").alias("nation"), "s_suppkey", F.concat_ws("|", c("s_suppkey").cast("string"), "s_name").alias("line"))
    lines.repartition("nation").sortWithinPartitions("nation", "s_suppkey").select("nation", "line").write.partitionBy("nation").text(folder)
    mark = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (key % 3 + 1).cast("int"))
    write_files(t.region.select(F.concat(mark, "r_name", F.lit(".bin")).alias("name"), F.when(key != 4, F.repeat("r_name", F.lit(300_000))).alias("content")), folder)
    steps = F.split("path", "/")
    name, above = F.element_at(steps, -1), F.element_at(steps, -2)
    # Checksum files of a local file system are not part of the set.
    found = rd.file_digests(t.spark, folder).filter(~c("path").endswith(".crc"))
    return found.select(F.when(above.startswith("nation="), above).otherwise(name).alias("file"), "sha256", "size_bytes", "hidden", "read_error")
