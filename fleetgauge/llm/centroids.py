"""Exact integer k-means with PCA-rotated lower bounds.

Vectors become integers once.  A rotation by the leading principal axes (fitted on the second
moments of all rows) splits the squared distance of a vector and a centroid into a part over the
leading coordinates, kept as it is, and a remainder that is at least the squared difference of
the two residual norms.  The sum of both bounds the distance from below; centroids whose bound
is above the exact distance to the most promising one are left out, the others are compared in
integers.  So the rotation decides how much is computed, never the result.

Vectors, sums and distances stay distributed: a task holds one Arrow batch and one row of sums
per centroid; only the centroids themselves (``clusters`` rows) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.storage import saved

# Squared distances of 64 such components stay far inside 64 bits.
COMPONENT_LIMIT = 1 << 26
LEADING = 16


def quantised(vector: Column, dimensions: int, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null unless there are exactly ``dimensions`` usable ones."""
    x = F.transform(vector, lambda v: F.lit(float(scale)) * v.cast("double"))
    inside = lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -COMPONENT_LIMIT) & (v < COMPONENT_LIMIT)
    return F.when((F.size(vector) == dimensions) & F.forall(x, inside), F.transform(x, lambda v: F.floor(v).cast("int")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def principal_axes(vectors: DataFrame, dimensions: int, leading: int) -> np.ndarray:
    """Leading axes of all rows as orthonormal columns; one row of moments per task, added up by position."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            x = np.pad(_matrix(batch.column("v"), dimensions).astype(float), ((0, 0), (0, 1)), constant_values=1.0)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = vectors.select("v").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("at", "part"))
    flat = np.zeros((dimensions + 1) ** 2)
    for row in parts.groupBy("at").agg(F.sum("part").alias("total")).collect():
        flat[row.at] = row.total
    square = flat.reshape(dimensions + 1, dimensions + 1)
    count = max(square[-1, -1], 1.0)
    mean = square[-1, :-1] / count
    _, axes = np.linalg.eigh(square[:-1, :-1] / count - np.outer(mean, mean))
    return axes[:, ::-1][:, :leading]


def assign(x: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number on ties) and squared distance of each row, and how many pairs were compared in integers."""

    def rotated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.astype(float)
        lead = rows @ axes
        norms = (rows * rows).sum(1)
        return lead, np.sqrt(np.maximum(norms - (lead * lead).sum(1), 0.0)), norms

    x_lead, x_rest, x_norms = rotated(x)
    c_lead, c_rest, c_norms = rotated(centroids)
    bound = (x_lead * x_lead).sum(1)[:, None] + (c_lead * c_lead).sum(1) - 2.0 * (x_lead @ c_lead.T)
    bound += (x_rest[:, None] - c_rest) ** 2
    # Rounding of the terms above, the square roots included, can lift a bound over the true distance by far less than this.
    bound -= 1e-6 * (x_norms[:, None] + c_norms) + 1e-6
    exact = lambda rows, at: ((x[rows] - centroids[at]) ** 2).sum(1)
    every = np.arange(len(x))
    first = bound.argmin(1)
    best = exact(every, first)
    open_ = bound <= best[:, None]
    open_[every, first] = False
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[every, first] = best
    rows, at = np.nonzero(open_)
    found[rows, at] = exact(rows, at)
    nearest = found.argmin(1)
    return nearest, found[every, nearest], len(x) + len(rows)


def _sums(vectors: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> list[list[int]]:
    """Per centroid: component sums and, last, the number of its vectors."""
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dimensions)
            if len(x):
                nearest, _, _ = assign(x, centroids, axes)
                np.add.at(total, nearest, np.pad(x, ((0, 0), (0, 1)), constant_values=1))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64()))], names=["s"])

    parts = vectors.select("v").mapInArrow(add, "s array<long>").select(F.posexplode("s").alias("at", "part"))
    flat = [0] * (k * (dimensions + 1))
    for row in parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        flat[row.at] = int(row.total)
    return [flat[i * (dimensions + 1):(i + 1) * (dimensions + 1)] for i in range(k)]


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64,
                    clusters: int = 16, rounds: int = 3, seed: str = "1", leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row.

    Vectors that are null, of another length, or hold null or non-finite components are left out,
    and so are components beyond +-2**26 after scaling, whose distances would leave 64 bits.
    Starts are the rows with the smallest SHA-256 of ``seed:vec_id`` (null ids last, equal digests
    by vector); fewer rows give fewer centroids, an empty table gives no rows.  Equal distances go
    to the smaller number, centroids that lose all rows stay where they are, repeated rows count
    each.  Other columns of ``df`` are not read.  Sums beyond 64 bits are null.
    """
    ints = quantised(F.col(vector), dimensions, scale)
    vectors = saved(df.select(F.col(vec_id).alias("i"), ints.alias("v")).filter("v IS NOT NULL"), "quantised")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), 256)
    starts = vectors.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    centroids = np.array([r.v for r in starts], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        axes = np.zeros((dimensions, 0))
    else:
        axes = principal_axes(vectors, dimensions, min(leading, dimensions))
        for _ in range(rounds):
            sums = _sums(vectors, centroids, axes)
            centroids = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(sums, centroids.tolist())], np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, distance, _ = assign(_matrix(batch.column("v"), dimensions), centroids, axes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i"), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], names=["i", "cluster", "distance"])

    kind = vectors.schema["i"].dataType.simpleString()
    labelled = saved(vectors.mapInArrow(label, f"i {kind}, cluster int, distance long"), "labelled")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.total) for r in labelled.groupBy("cluster").agg(total.alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(c, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, n in inertia.items()]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid, so at most ``clusters`` rows.
    return labelled.join(F.broadcast(facts), "cluster").select(
        F.col("i").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
