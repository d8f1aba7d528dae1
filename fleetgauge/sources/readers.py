"""Readers for manifests, logs, samples, traces, tensors and artifact digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R
from fleetgauge.functions.scalars import utc_timestamp
from fleetgauge.operators.intervals import enum_filter, resolve_names, single_window, trace_findings
from fleetgauge.operators.segments import join_on
from fleetgauge.sources import schemas as sm
from fleetgauge.sources.files import read_files

# Layout ``<implementation>/round-NN/run-01/manifest.json``.
MANIFEST_PATH = r"([^/]+)/round-(\d+)/run-\d+/manifest\.json$"


def read_run_manifests(spark: SparkSession, paths: str, schema: str = sm.MANIFEST, multi_line: bool = True,
                       layout: str = MANIFEST_PATH) -> DataFrame:
    """Run manifests with ``implementation`` and ``round`` taken from the path.

    A document that is not a JSON object keeps its text in ``_corrupt_record`` and is marked
    in ``read_error``; its other columns are null.  Files that Spark's scan passes over, those
    without content and those with a hidden name, come back as marked rows too.
    """
    raw = (
        spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", multi_line)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    )
    # The metadata path is a URL; a plus sign in it stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    read = raw.select("*", path.alias("path")).withColumn("read_error", F.when(F.col("_corrupt_record").isNotNull(), "not a JSON object"))
    passed = read_files(spark, paths).filter((F.col("path").rlike(layout)) & (F.col("hidden") | (F.col("size_bytes") == 0))).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.when(F.col("hidden"), "hidden file").otherwise("empty file").alias("read_error"))
    every = read.unionByName(passed, allowMissingColumns=True)
    return every.withColumns({
        "implementation": F.regexp_extract("path", layout, 1), "round": F.regexp_extract("path", layout, 2).try_cast("int")})


def event_shape_errors(df: DataFrame) -> DataFrame:
    """Add UTC stamps and the ordered shape ``errors`` of execution events."""
    c = F.col
    below = lambda n: ~R.when_present(c(n) >= 0)
    return df.withColumns({
        "started": utc_timestamp(c("started_at_utc")), "finished": utc_timestamp(c("finished_at_utc")),
    }).withColumn("errors", R.labels([
        ("unsupported schema", R.differs(c("schema_version"), F.lit(1))),
        ("indexes must be positive", ~(R.positive(c("attempt_index")) & R.positive(c("sequence_index")))),
        ("invalid status", ~F.coalesce(c("status").isin(*sm.EVENT_STATUSES), F.lit(False))),
        ("idle durations cannot be negative", below("required_idle_seconds") | below("observed_idle_seconds")),
        ("duration cannot be negative", below("duration_seconds")),
        ("timestamps must include a timezone", c("started").isNull() | c("finished").isNull()),
    ]))


def read_event_log(spark: SparkSession, path: str, extra: str = "", streaming: bool = False) -> DataFrame:
    """Append-only JSON-lines execution events; blank lines are skipped, bad shapes are marked."""
    reader = spark.readStream if streaming else spark.read
    return event_shape_errors(reader.schema(sm.EVENT + extra).json(path))


def read_telemetry(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Device samples from JSON lines; nulls are kept, missing reasons become an empty array."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(sm.SAMPLE).json(path).withColumn(
        "throttle_reasons", F.coalesce("throttle_reasons", F.array().cast("array<string>")))


def read_trace_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven trace tables, exported as one Parquet table each; absent ones are an error."""
    base = folder.rstrip("/")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    missing = [n for n in sorted(sm.TRACE_TABLES) if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}"))]
    if missing:
        raise FileNotFoundError(f"trace lacks tables: {', '.join(missing)}")
    return {name: spark.read.parquet(f"{base}/{name}") for name in sm.TRACE_TABLES}


def analyse_trace(tables: dict[str, DataFrame], keys: list[str], loop_label: str, width: int, frames: Column) -> DataFrame:
    """Findings of every trace from its native tables, all of which carry ``keys``.

    Every trace with a marker or a kernel comes back; one without a single complete loop has
    ``window_error`` and no findings.
    """
    labelled = resolve_names(tables["NVTX_EVENTS"].withColumn("_id", F.col("textId")), tables["StringIds"], "_id", "text", keys=keys)
    traces = tables["NVTX_EVENTS"].select(*keys).unionByName(tables["CUPTI_ACTIVITY_KIND_KERNEL"].select(*keys)).distinct()
    found = single_window(labelled, keys, F.col("label") == loop_label)
    state = join_on(traces, found.withColumn("_hit", F.lit(True)), keys, "left").select(
        *keys, "win_start", "win_end", F.when(F.col("_hit").isNull(), "lacks one complete window").otherwise(F.col("window_error")).alias("window_error"))
    windows = state.filter(F.col("window_error").isNull())
    engines = [
        enum_filter(tables["GPU_VIDEO_ENGINE_WORKLOAD"], tables["ENUM_VIDEO_ENGINE_TYPE"], "engineType", name, keys)
        .select(*keys, "start", "end", F.lit(kind).alias("engine")) for name, kind in sm.VIDEO_ENGINES.items()
    ]
    copies = [
        enum_filter(tables["CUPTI_ACTIVITY_KIND_MEMCPY"], tables["ENUM_CUDA_MEMCPY_OPER"], "copyKind", name, keys)
        .select(*keys, "start", "end", "bytes", F.lit(kind).alias("direction")) for name, kind in sm.COPY_KINDS.items()
    ]
    moved = copies[0].unionByName(copies[1]).unionByName(copies[2])
    findings = trace_findings(
        windows.drop("window_error"), tables["CUPTI_ACTIVITY_KIND_KERNEL"], engines[0].unionByName(engines[1]), moved, keys, width, frames)
    return join_on(state.select(*keys, "window_error"), findings, keys, "left")


def decode_tensors(df: DataFrame, content: str, length: Column, expected_elements: Column, out: str = "values") -> DataFrame:
    """Little-endian float32 bytes as an array; rows of the wrong size keep null values and an error."""
    fits = length == expected_elements.cast("long") * 4

    @F.pandas_udf("array<float>")
    def floats(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    marked = df.withColumn("size_error", F.when(~R.when_present(fits), "size does not match float32 shape"))
    return marked.withColumn(out, floats(F.when(F.col("size_error").isNull(), F.col(content)))).drop(content)


def read_frame_tensors(spark: SparkSession, paths: str, elements: Column) -> DataFrame:
    """Raw float32 CHW files, one per row, checked against the expected number of elements.

    Files without content come back with an error; ``elements`` may use ``path``.
    """
    files = read_files(spark, paths, "content").select("path", F.col("size_bytes").alias("length"), "content")
    return decode_tensors(files, "content", F.col("length"), elements)


def file_digests(spark: SparkSession, paths: str, shares: int = 1) -> DataFrame:
    """Path, SHA-256, size and hidden mark of every artifact, empty and hidden ones included.

    All sizes are hashed in one way, as they stream by; a file that cannot be read has a
    ``read_error`` and no digest.  ``shares`` deals the files of each folder to that many tasks.
    """
    return read_files(spark, paths, "sha256", shares).select("path", "sha256", "size_bytes", "hidden", "read_error")
