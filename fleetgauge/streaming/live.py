"""Streaming forms of the sample, session and sequence rules.

Each ``stream_*`` function maps a streaming DataFrame to a streaming DataFrame; ``run_once``
drives one to the end of the available data with a recoverable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetgauge.operators.telemetry import INVALID_REASONS
from fleetgauge.session import new_folder


def stream_telemetry_rollup(samples: DataFrame, keys: Sequence[str], ts: str, value: str, length: str, late: str) -> DataFrame:
    """Mean and peak per run and tumbling window; later data than ``late`` is not waited for."""
    return samples.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(
        F.count("*").alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("peak")
    ).select(*keys, F.col("window.start").alias("window_start"), "samples", "mean", "peak")


def stream_sliding_rate(frames: DataFrame, keys: Sequence[str], ts: str, length: str, slide: str, seconds: float, late: str) -> DataFrame:
    """Frames per second over a sliding window."""
    return frames.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("frames")).select(
        *keys, F.col("window.start").alias("window_start"), "frames", (F.col("frames") / seconds).alias("fps"))


def stream_idle_sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions split where a run rests for at least ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("events")).select(
        *keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def stream_first_last_marker(progress: DataFrame, keys: Sequence[str], stamp: str, ts: str, length: str, late: str) -> DataFrame:
    """First and last completed frame of each run, in parts of ``length``; ``merge_markers`` joins the parts.

    A part's state is two numbers and a count, and leaves once the watermark has passed it, so a
    run that rests costs nothing, however many there are.  A run that goes on later opens a new part.
    """
    return progress.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(
        F.min(stamp).alias("first_frame"), F.max(stamp).alias("last_frame"), F.count("*").alias("frames")).select(
        *keys, F.col("window.start").alias("part_start"), "first_frame", "last_frame", "frames")


def merge_markers(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last frame and frame count of each run from its parts."""
    return parts.groupBy(*keys).agg(
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum("frames").alias("frames"))


def _fold_ranges(ranges: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
    """Merge indexes into disjoint closed ranges; also count indexes seen before."""
    fresh, counts = np.unique(values, return_counts=True)
    repeated = int(counts.sum() - fresh.size)
    if ranges.size:
        at = np.searchsorted(ranges[:, 0], fresh, side="right") - 1
        known = (at >= 0) & (fresh <= ranges[np.maximum(at, 0), 1])
        repeated += int(known.sum())
        fresh = fresh[~known]
    points = np.column_stack([fresh, fresh])
    both = np.concatenate([ranges.reshape(-1, 2), points])
    both = both[np.argsort(both[:, 0], kind="stable")]
    if not both.size:
        return both, repeated
    opens = np.r_[True, both[1:, 0] > both[:-1, 1] + 1]
    closes = np.r_[opens[1:], True]
    return np.column_stack([both[opens, 0], both[closes, 1]]), repeated


def stream_sequence_guard(events: DataFrame, key: str, index: str, in_order: Column, range_size: int = 100_000) -> DataFrame:
    """Facts of each campaign's attempts per range of ``range_size`` indexes; ``merge_guard`` gives the verdict.

    A campaign is dealt to one state per index range, so a long one is kept by many tasks.  A
    state holds the seen indexes as merged intervals, one where all is in order, and is read
    chunk by chunk.  ``in_order`` says whether a row is the expected step; a null index counts as 0.
    """
    at = F.coalesce(F.col(index).cast("long"), F.lit(0))
    data = events.select(
        F.col(key).cast("string").alias("key"), F.floor((at - 1) / range_size).cast("long").alias("part"), at.alias("at"),
        F.coalesce(in_order, F.lit(False)).alias("ok"))

    def judge(name: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, repeated, wrong = state.get if state.exists else ([], 0, 0)
        ranges = np.asarray(flat, dtype=np.int64).reshape(-1, 2)
        for chunk in chunks:
            ranges, again = _fold_ranges(ranges, chunk["at"].to_numpy(dtype=np.int64))
            repeated += again
            wrong += int((~chunk["ok"].astype(bool)).sum())
        state.update(([int(v) for v in ranges.ravel()], repeated, wrong))
        seen = int((ranges[:, 1] - ranges[:, 0] + 1).sum())
        yield pd.DataFrame({
            "key": [name[0]], "part": [name[1]], "seen": [seen], "least": [int(ranges[0, 0])], "most": [int(ranges[-1, 1])],
            "repeated": [repeated], "wrong": [wrong]})

    return data.groupBy("key", "part").applyInPandasWithState(
        judge, "key string, part long, seen long, least long, most long, repeated long, wrong long",
        "ranges array<bigint>, repeated bigint, wrong bigint", "update", GroupStateTimeout.NoTimeout)


def merge_guard(parts: DataFrame) -> DataFrame:
    """Verdict per campaign: are attempts exactly 1..n, each once, and how many steps were not the expected ones."""
    whole = (F.sum("seen") == F.max("most")) & (F.min("least") == 1) & (F.sum("repeated") == 0)
    return parts.groupBy("key").agg(
        F.sum(F.col("seen") + F.col("repeated")).alias("attempts"), whole.alias("contiguous"), F.sum("wrong").alias("unexpected_steps"))


def stream_throttle_alerts(samples: DataFrame, reasons: str = "throttle_reasons") -> DataFrame:
    """Rows that carry a reason which spoils a measurement; no state."""
    bad = F.array_sort(F.array_intersect(reasons, F.array(*[F.lit(r) for r in INVALID_REASONS])))
    return samples.withColumn("invalid_reasons", bad).filter(F.size("invalid_reasons") > 0)


def stream_dedup_events(events: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Exactly one event per key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_extension_trigger(runs: DataFrame, keys: Sequence[str], index: str, value: str, initial_runs: int, ts: str, length: str, late: str) -> DataFrame:
    """The first ``initial_runs`` values of each suite, in parts of ``length``; ``extension_verdict`` decides.

    The decision needs just those values, so the state of a part is that many numbers, and it
    leaves once the watermark has passed the part.
    """
    slots = [F.max(F.when(F.col(index) == i, F.col(value))).alias(f"r{i}") for i in range(1, initial_runs + 1)]
    return runs.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(*slots).select(
        *keys, F.col("window.start").alias("part_start"), *[f"r{i}" for i in range(1, initial_runs + 1)])


def extension_verdict(parts: DataFrame, keys: Sequence[str], initial_runs: int, threshold: float) -> DataFrame:
    """Flag suites whose first ``initial_runs`` values spread more than the threshold, from all their parts."""
    state = parts.groupBy(*keys).agg(*[F.max(f"r{i}").alias(f"_r{i}") for i in range(1, initial_runs + 1)])
    values = F.array_sort(F.array_compact(F.array(*[F.col(f"_r{i}") for i in range(1, initial_runs + 1)])))
    at = lambda i: F.try_element_at("_v", F.lit(i))
    half = initial_runs // 2
    median = at(half + 1) if initial_runs % 2 else (at(half) + at(half + 1)) / 2
    spread = F.when((F.size("_v") == initial_runs) & (median > 0), (at(initial_runs) - at(1)) / median)
    return state.withColumn("_v", values).select(
        *keys, F.size("_v").alias("runs"), spread.alias("relative_spread"), F.coalesce(spread > threshold, F.lit(False)).alias("extend"))


class Closing:
    """A second source of a stream whose only row, in the far future, closes every open window.

    ``events`` joins it to a stream before its watermark; ``run_once`` writes the row after all
    data is through and runs one more batch, which the watermark then carries past all windows.
    The row has no values but its time and its own window never closes, so it is in no result.
    """

    def __init__(self, stream: DataFrame, ts: str, label: str = "closing") -> None:
        self.spark, self.schema, self.ts = stream.sparkSession, stream.schema, ts
        self.folder = new_folder(self.spark, label)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields])
        self.events = stream.unionByName(self.spark.readStream.schema(nullable).parquet(self.folder))

    def close(self) -> None:
        far = F.lit("9999-01-01 00:00:00").cast("timestamp")
        row = [far.cast(f.dataType).alias(f.name) if f.name == self.ts else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(self.folder)


def run_once(stream: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = (), closing: Closing | None = None,
             checkpoint: str | None = None) -> DataFrame:
    """Process what is available, then return the written result as a batch DataFrame.

    Append results go to a Parquet sink; what the watermark has not closed is left out unless
    ``closing`` closes it.  In update mode every batch is written under its own number (a
    repeated batch overwrites itself) and the newest row per key is returned, open windows included.
    """
    spark: SparkSession = stream.sparkSession
    out, state = new_folder(spark, f"{label}-out"), checkpoint or new_folder(spark, f"{label}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    writer = writer.format("parquet").option("path", out) if mode == "append" else writer.foreachBatch(save)
    writer.start().awaitTermination()
    if closing is not None:
        closing.close()
        writer.start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    rest = [n for n in stream.columns if n not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", out).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")
