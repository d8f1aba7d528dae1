"""Largest inner products through vantage-point trees per shard, with relaxed triangle-inequality pruning.

Inner products become distances by one more component, ``sqrt(M**2 - |x|**2)`` with the largest
norm ``M`` (0 for queries): the nearer, the larger the inner product.  A vantage-point tree halves
vectors by their distance to a chosen vector; a half whose border is further from the query than
``factor`` times the distance of the query's k-th best so far is left out.  Factor one is the
triangle inequality itself and gives exact results, smaller factors leave out more.

A tree over a bounded sample cuts the space into regions; regions of more than ``shard_rows``
vectors are dealt into several shards by hash.  Every vector is in exactly one shard, and every
shard has its own tree over all its vectors.  Queries search the shards of their own region first
and carry the k-th score from there to the regions that it does not exclude.  A task holds one
shard (bounded) while queries stream by in batches; the queries of a shard are dealt into blocks.

Equal vectors are one point with their ``k + 1`` smallest ids, enough for any answer, so a hot
vector is one point and a hot query is searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.storage import saved

# Bounded parameters: rows that fit the region tree, vectors of a shard, queries of a block, of a batch, and vectors of a leaf.
SAMPLE_ROWS = 4096
SHARD_ROWS = 16_384
QUERY_BLOCK = 8192
QUERY_BATCH = 512
LEAF_ROWS = 64
HELD_CANDIDATES = 1 << 20
FACTOR = 0.2


class Geometry:
    """Scaled vectors with the component that turns inner products into distances."""

    def __init__(self, largest: float, norm: float) -> None:
        self.largest, self.norm = largest, norm
        # Rounding of distances near zero, square roots included.
        self.slack = 1e-7 * norm

    def point(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(1), 0.0))])

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / self.largest, np.zeros(len(x))])

    def scaled(self, score: np.ndarray) -> np.ndarray:
        """Scores of original vectors as scores of scaled ones; what is no number leaves nothing out."""
        with np.errstate(all="ignore"):
            out = score / self.largest / self.largest
        return np.where(np.isfinite(score), out, -np.inf)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2.0 * (x @ y.T), 0.0))


class VantageTree:
    """Vectors halved by distance to vantage points until a leaf has at most ``leaf`` of them (more if they cannot be told apart)."""

    def __init__(self, points: np.ndarray, leaf: int, tries: int = 8) -> None:
        chosen, borders, self.steps, self.leaves = [], [], [], []
        random_ = np.random.default_rng(len(points))
        waiting: list[tuple[np.ndarray, tuple[tuple[int, int], ...] | None, int]] = [(np.arange(len(points)), None, 0)]
        # steps: (node, parent, side), parents first; a leaf has the node number -1 - its own number.
        while waiting:
            rows, parent, side = waiting.pop()
            cut = self._cut(points, rows, random_, tries) if len(rows) > leaf else None
            if cut is None:
                self.steps.append((-1 - len(self.leaves), parent, side))
                self.leaves.append(rows)
                continue
            vantage, border, near = cut
            node = len(chosen)
            self.steps.append((node, parent, side))
            chosen.append(points[vantage])
            borders.append(border)
            waiting += [(rows[~near], node, 1), (rows[near], node, -1)]
        self.vantage, self.border = np.array(chosen).reshape(-1, points.shape[1]), np.array(borders)

    @staticmethod
    def _cut(points: np.ndarray, rows: np.ndarray, random_: np.random.Generator, tries: int):
        seen = rows if len(rows) <= 256 else random_.choice(rows, 256, replace=False)
        offered = random_.choice(rows, min(tries, len(rows)), replace=False)
        spread = distances(points[seen], points[offered]).std(0)
        vantage = offered[spread.argmax()]
        far = distances(points[rows], points[vantage][None])[:, 0]
        ordered = np.sort(far)
        if ordered[0] == ordered[-1]:
            return None
        border = ordered[(len(rows) - 1) // 2]
        if border == ordered[-1]:
            border = ordered[np.searchsorted(ordered, border) - 1]
        return vantage, float(border), far <= border

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of every query to every leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not len(self.border):
            return out
        off = distances(queries, self.vantage) - self.border
        held = {}
        for node, parent, side in self.steps:
            bound = np.zeros(len(queries)) if parent is None else np.maximum(held[parent], -side * off[:, parent])
            if node < 0:
                out[:, -1 - node] = bound
            else:
                held[node] = bound
        return out

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each vector belongs to."""
        out = np.zeros(len(points), np.int64)
        if not len(self.border):
            return out
        near = distances(points, self.vantage) <= self.border
        inside = {}
        for node, parent, side in self.steps:
            here = np.ones(len(points), bool) if parent is None else inside[parent] & (near[:, parent] if side < 0 else ~near[:, parent])
            if node < 0:
                out[here] = -1 - node
            else:
                inside[node] = here
        return out


def inner_products(x: np.ndarray, rows: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, components added from the first to the last."""
    out = np.zeros(len(rows))
    with np.errstate(all="ignore"):
        for a in range(0, len(rows), 1 << 16):
            part = slice(a, a + (1 << 16))
            for k in range(x.shape[1]):
                out[part] += x[rows[part], k] * y[at[part], k]
    return out


class Shard:
    """All vectors of one shard with their tree; ``order`` ranks them among equal scores."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, geometry: Geometry, leaf: int) -> None:
        self.vectors, self.order, self.geometry = vectors, order, geometry
        self.points = geometry.point(vectors)
        self.tree = VantageTree(self.points, leaf)
        self.compared = 0

    def search(self, queries: np.ndarray, floor: np.ndarray, count: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, vector row and score of the ``count`` best of each query, of those not below its ``floor``."""
        geometry = self.geometry
        asked = geometry.query(queries)
        norms = np.sqrt((asked * asked).sum(1))
        margin = 1e-11 * norms * geometry.norm
        start = geometry.scaled(floor)
        best = np.repeat(start[:, None], count, 1)
        bound = self.tree.bounds(asked)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, at, rough = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            keep = rough >= best[rows, -1] - margin[rows]
            rows, at, rough = rows[keep], at[keep], rough[keep]
            score = inner_products(queries, rows, self.vectors, at)
            order = np.lexsort((self.order[at], -score, rows))
            rows, at, rough, score = rows[order], at[order], rough[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = place < count
            held[:] = [(rows[keep], at[keep], rough[keep])]
            return rows[keep], at[keep], score[keep]

        def visit(leaf: int, who: np.ndarray) -> None:
            members = self.tree.leaves[leaf]
            for a in range(0, len(members), 4096):
                part = members[a:a + 4096]
                rough = asked[who, :-1] @ self.points[part, :-1].T
                self.compared += rough.size
                good = rough >= (best[who, -1] - margin[who])[:, None]
                some = good.any(1)
                rows, at = np.nonzero(good)
                held.append((who[rows], part[at], rough[rows, at]))
                both = np.concatenate([best[who[some]], rough[some]], 1)
                best[who[some]] = -np.sort(np.partition(-both, count - 1, 1)[:, :count], 1)
                if sum(len(x[0]) for x in held) > HELD_CANDIDATES:
                    settle()

        home = bound.argmin(1)
        for leaf in np.unique(home):
            visit(leaf, np.flatnonzero(home == leaf))
        for leaf in np.argsort(bound.mean(0), kind="stable"):
            reach = np.sqrt(np.maximum(norms ** 2 + geometry.norm ** 2 - 2.0 * best[:, -1], 0.0))
            open_ = (bound[:, leaf] <= factor * reach + geometry.slack) & (home != leaf)
            if open_.any():
                visit(leaf, np.flatnonzero(open_))
        return settle()


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """The vector in double precision; null where it is null, empty, zero, or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when((F.size(vector) > 0) & F.forall(x, finite) & F.exists(x, lambda v: v != 0.0), x)


def _smallest_ids(rows: DataFrame, count: int) -> DataFrame:
    """v and its ``count`` smallest ids, null last; Spark limits each group before it is shuffled."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("i"))
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= count)
    # At most ``count`` rows a vector.
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "i"))), lambda e: e["i"])
    return first.groupBy("v").agg(listed.alias("ids"))


def _region_trees(rows: DataFrame, counts: dict[int, int], geometry: Geometry, sample_rows: int, shard_rows: int) -> dict[int, VantageTree]:
    """One small tree per vector length, over a sample of at most ``sample_rows`` rows."""
    sample: dict[int, set] = {}
    for row in rows.orderBy(F.xxhash64("i", "v"), "v").select("v").limit(sample_rows).collect():
        sample.setdefault(len(row.v), set()).add(tuple(row.v))
    trees = {}
    for size, found in sample.items():
        regions = min(math.ceil(counts[size] / shard_rows), max(len(found) // 8, 1))
        trees[size] = VantageTree(geometry.point(np.array(sorted(found))), math.ceil(len(found) / regions))
    return trees


def nearest_vectors(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", factor: float = FACTOR,
                    shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, query_block: int = QUERY_BLOCK, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products found for each row of ``is_query``.

    Candidates are all rows but the query's own; ties go to the smaller id, null ids last.  Vectors
    that are null, empty or zero, or hold null or non-finite components take no part; vectors of
    different lengths never meet.  Repeated rows are candidates each, and a repeated query row is
    answered as often as it comes.  Fewer than ``k`` candidates give fewer rows, an empty table
    none.  Scores that overflow to no number come last.  Other columns are read only by
    ``is_query``.
    """
    reach = k + 1
    rows = df.select(F.col(vec_id).alias("i"), usable(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).filter("v IS NOT NULL")
    kind = df.schema[vec_id].dataType.simpleString()
    spark = df.sparkSession
    out = f"qid long, score double, same boolean, ids array<{kind}>"
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    if largest is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    scaled = F.aggregate(F.transform("v", lambda x: (x / largest) * (x / largest)), F.lit(0.0), lambda s, x: s + x)
    shapes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(scaled).alias("square")).collect()
    geometry = Geometry(largest, math.sqrt(max(r.square for r in shapes)))
    trees = _region_trees(rows, {r["size"]: r.n for r in shapes}, geometry, sample_rows, shard_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            region = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                if int(size) in trees:
                    at = np.flatnonzero(sizes == size)
                    region[at] = trees[int(size)].leaf_of(geometry.point(_vectors(batch.column("v").take(pa.array(at)))))
            yield batch.append_column("size", pa.array(sizes, pa.int32())).append_column("region", pa.array(region, pa.int32()))

    located = "size int, region int"
    points = saved(_smallest_ids(rows.select("i", "v"), reach).mapInArrow(route, f"v array<double>, ids array<{kind}>, {located}"), "points")
    asked = rows.filter("asked").select("i", "v")
    queries = saved(asked.select("v").distinct().mapInArrow(route, f"v array<double>, {located}").withColumn("qid", F.monotonically_increasing_id()), "queries")
    # One row per region: at most sample_rows / 8 of them and one per further vector length.
    shards = {(r["size"], r.region): math.ceil(r.n / shard_rows) for r in points.groupBy("size", "region").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(s, r, n) for (s, r), n in shards.items()], f"{located}, shards int")

    def search(visits: DataFrame) -> DataFrame:
        """Best points of each shard for queries (qid, v, size, region, floor) that visit a region."""
        load = visits.groupBy("size", "region").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        parts = F.broadcast(table).join(load, ["size", "region"])
        shard, block = F.sequence(F.lit(0), F.col("shards") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
        cell = lambda s, b: F.struct("size", "region", s.alias("shard"), b.alias("block"))
        stored = points.join(F.broadcast(parts), ["size", "region"]).select(
            "v", "ids", "size", "region", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int").alias("shard"), F.explode(block).alias("block"))
        stored = stored.select(cell(F.col("shard"), F.col("block")).alias("cell"), "v", "ids", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("double").alias("floor"))
        moving = visits.join(F.broadcast(parts), ["size", "region"]).select(
            "v", "qid", "floor", "size", "region", F.explode(shard).alias("shard"), F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"))
        moving = moving.select(cell(F.col("shard"), F.col("block")).alias("cell"), "v", F.lit(None).cast(f"array<{kind}>").alias("ids"), "qid", "floor")
        both = stored.unionByName(moving).repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("qid"))
        return both.select(F.to_json("cell").alias("cell"), "v", "ids", "qid", "floor").mapInArrow(find, out)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, stored, shard, ids = None, [], None, None
        for batch in batches:
            names = batch.column("cell").to_pylist()
            is_point = pc.is_null(batch.column("qid")).to_numpy(zero_copy_only=False)
            edges = [n for n in range(len(names)) if not n or names[n] != names[n - 1] or is_point[n] != is_point[n - 1]] + [len(names)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if names[a] != cell:
                    cell, stored, shard = names[a], [], None
                if is_point[a]:
                    stored.append(part.select(["v", "ids"]))
                    continue
                if shard is None:
                    table_ = pa.Table.from_batches(stored).combine_chunks()
                    ids = table_.column("ids").combine_chunks()
                    order = np.empty(len(ids), np.int64)
                    order[pc.sort_indices(pc.list_element(ids, 0), null_placement="at_end").to_numpy()] = np.arange(len(ids))
                    shard, stored = Shard(_vectors(table_.column("v").combine_chunks()), order, geometry, leaf_rows), []
                for at in range(0, b - a, QUERY_BATCH):
                    few = part.slice(at, QUERY_BATCH)
                    x = _vectors(few.column("v"))
                    floor = few.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    rows_, found, score = shard.search(x, floor, reach, factor)
                    yield pa.RecordBatch.from_arrays([
                        few.column("qid").take(pa.array(rows_)), pa.array(score), pa.array((x[rows_] == shard.vectors[found]).all(1)),
                        ids.take(pa.array(found))], names=["qid", "score", "same", "ids"])

    def merged(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.isnan("score"), F.desc("score"), F.col("ids")[0].asc_nulls_last())
        return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= reach)

    nothing = F.lit(None).cast("double").alias("floor")
    best = saved(merged(search(queries.select("qid", "v", "size", "region", nothing))).drop("n"), "own-region")
    if len(shards) > len({size for size, _ in shards}):
        floors = best.groupBy("qid").agg(F.when(F.count("*") >= reach, F.min("score")).alias("floor"))
        with_floor = queries.join(floors, "qid", "left")

        def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for every other region that the k-th score does not exclude."""
            for batch in batches:
                sizes, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "region"))
                floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                for size in np.unique(sizes):
                    if int(size) not in trees:
                        continue
                    at = np.flatnonzero(sizes == size)
                    x = geometry.query(_vectors(batch.column("v").take(pa.array(at))))
                    with np.errstate(all="ignore"):
                        limit = np.sqrt(np.maximum((x * x).sum(1) + geometry.norm ** 2 - 2.0 * geometry.scaled(floor[at]), 0.0))
                    open_ = trees[int(size)].bounds(x) <= factor * limit[:, None] + geometry.slack
                    open_[np.arange(len(at)), own[at]] = False
                    who, where = np.nonzero(open_)
                    for a in range(0, len(who), 4096):
                        chosen = batch.take(pa.array(at[who[a:a + 4096]]))
                        yield pa.RecordBatch.from_arrays(
                            [chosen.column("qid"), chosen.column("v"), chosen.column("size"), pa.array(where[a:a + 4096], pa.int32()), chosen.column("floor")],
                            names=["qid", "v", "size", "region", "floor"])

        visits = with_floor.select("qid", "v", "size", "region", "floor").mapInArrow(further, f"qid long, v array<double>, {located}, floor double")
        more = search(saved(visits, "visits"))
        best = saved(merged(best.unionByName(more)).drop("n"), "all-regions")

    # At most ``reach`` points a query, each of at most ``reach`` ids.
    lists = best.groupBy("qid").agg(F.collect_list(F.struct("score", "same", "ids")).alias("found"))
    answered = asked.withColumnRenamed("i", "query_id").join(queries.select("v", "qid"), "v").drop("v").join(lists, "qid")
    entry = lambda e, i: F.struct(F.isnan(e["score"]).alias("odd"), (-e["score"]).alias("below"), i.isNull().alias("none"), i.alias("i"), e["same"].alias("same"), e["score"].alias("score"))
    flat = F.array_sort(F.flatten(F.transform("found", lambda e: F.transform(e["ids"], lambda i: entry(e, i)))))
    own = F.array_position(F.transform("flat", lambda e: e["same"] & e["i"].eqNullSafe(F.col("query_id"))), F.lit(True))
    rest = F.slice(F.filter("flat", lambda e, n: n + 1 != F.col("own")), 1, k)
    done = answered.withColumn("flat", flat).withColumn("own", own).select("query_id", F.posexplode(rest).alias("n", "e"))
    return done.select("query_id", (F.col("n") + 1).alias("rank"), F.col("e.i").alias("vec_id"), F.col("e.score").alias("score"))
