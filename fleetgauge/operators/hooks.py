"""User hooks: a metric and checks given as functions that return columns.

Hooks build column expressions, so they run inside the JVM and cost no Python per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from fleetgauge.functions import rules as R
from fleetgauge.operators.stats import suite_statistics


def metric_statistics(runs: DataFrame, keys: Sequence[str], metric_expr: Callable[[DataFrame], Column]) -> DataFrame:
    """Suite statistics of a metric the user supplies."""
    return suite_statistics(runs.withColumn("_metric", metric_expr(runs)), keys, "_metric")


def apply_checks(df: DataFrame, checks: Sequence[tuple[str, Callable[[DataFrame], Column]]]) -> DataFrame:
    """Add ordered ``errors`` from named rules; each rule returns the condition that is bad."""
    return df.withColumn("errors", R.labels([(name, rule(df)) for name, rule in checks]))
