"""Integer k-means against a plain version."""

import hashlib
import math

import numpy as np
import pytest

from fleetgauge.llm.centroids import assign, cluster_vectors


def plain(rows, dimensions, clusters, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(scale * x) < 1 << 26 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), digest[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("kind", ["normal", "grid", "copies", "wide"])
def test_against_plain_version(spark, kind):
    random_ = np.random.default_rng(8)
    x = random_.normal(size=(300, 5))
    if kind == "grid":
        x = random_.integers(-1, 2, size=(300, 5)) / 64.0
    elif kind == "copies":
        x[::2] = x[0]
    elif kind == "wide":
        x *= 10.0 ** random_.integers(-3, 6, size=(300, 1))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = cluster_vectors(df, dimensions=5, clusters=7, leading=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 5, 7, 3)


def test_odd_rows(spark):
    vectors = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [1.0, float("-inf")], [1e300, 0.0], [1e7, 0.0], [0.0, 0.0], [0.0, 0.0], [0.1, -0.1], [-0.0, 3.0], [2.0, 2.0]]
    rows = [(None if n == 10 else 5 if n > 10 else n, v) for n, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<double>, cluster string, distance string, i int, v int"
    df = spark.createDataFrame([(i, v, "c", "d", 1, 2) for i, v in rows], schema)
    for clusters in (1, 3, 16):
        got = cluster_vectors(df, dimensions=2, clusters=clusters)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 2, clusters, 3)
    assert cluster_vectors(df.limit(0)).count() == 0


def test_bounds_leave_out_but_never_decide():
    random_ = np.random.default_rng(1)
    centroids = random_.integers(-60, 60, size=(16, 12))
    x = centroids[random_.integers(0, 16, 2000)] + random_.integers(-9, 10, size=(2000, 12))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :6]
    nearest, distance, compared = assign(x, centroids, axes)
    every = ((x[:, None] - centroids) ** 2).sum(2)
    assert (nearest == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert compared < 0.3 * every.size
