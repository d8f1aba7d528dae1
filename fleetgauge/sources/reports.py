"""Report rows: fixed decimals for tables, series for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import fixed

# Report column -> (statistic, (digits, sign, suffix)).
SUMMARY_FORMATS = {
    "median_fps": ("median_fps", (3,)),
    "versus_baseline": ("relative_percent", (2, True, "%%")),
    "wall_sec": ("median_wall_time_sec", (2,)),
    "cpu_cores": ("median_cpu_cores", (3,)),
    "cpu_capacity_percent": ("median_cpu_capacity_percent", (2,)),
    "gpu_util_percent": ("median_gpu_utilization_percent", (2,)),
    "power_w": ("median_power_w", (2,)),
    "joules_per_frame": ("median_joules_per_frame", (3,)),
    "peak_vram_mib": ("median_peak_vram_mib", (1,)),
    "bitrate_mbps": ("median_output_bitrate_mbps", (3,)),
    "size_mib": ("median_output_size_mib", (1,)),
    "startup_sec": ("median_startup_sec", (3,)),
    "steady_state_sec": ("median_steady_state_frame_loop_sec", (3,)),
    "finalize_sec": ("median_finalize_mux_sec", (3,)),
}


def summary_sink_rows(df: DataFrame) -> DataFrame:
    """Text columns with fixed decimals for the statistics that are present; keys are kept."""
    present = {out: spec for out, spec in SUMMARY_FORMATS.items() if spec[0] in df.columns}
    used = {column for column, _ in present.values()}
    keys = [n for n in df.columns if n not in used]
    return df.select(*keys, *[fixed(F.col(column), *form).alias(out) for out, (column, form) in present.items()])


def sweep_series(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """Eligible points with automatic threads and no graph, flagged when they won."""
    flags = winners.select("implementation", "candidate_id").distinct().withColumn("_won", F.lit(True))
    points = candidates.filter(
        (F.col("status") == "eligible") & (F.col("threads") == "auto") & ~F.col("cuda_graph")
    )
    return (
        points.join(flags, ["implementation", "candidate_id"], "left")
        .select("implementation", "candidate_id", F.col("num_streams").alias("streams"), F.col("median_fps").alias("fps"),
                F.coalesce("_won", F.lit(False)).alias("winner"))
    )


def resource_limit_series(searches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per recorded ceiling of the map ``resource_limits`` (implementation -> struct)."""
    return searches.select(*keys, F.explode("resource_limits").alias("implementation", "_limit")).filter(
        F.col("_limit").isNotNull()
    ).select(*keys, "implementation", F.col("_limit.num_streams").alias("streams"), F.col("_limit.kind").alias("kind"))
