"""Evidence joins: pairing, lookups, completeness in both directions, locks and digests.

All joins are equi-joins; strategy and skew handling are left to adaptive execution.  Sides
are reduced to one row per key before joining, so no join can multiply rows unasked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import rules as R

# Rows of both sides that a task of ``evidence_set_errors`` gets, about.
TASK_ROWS = 500_000


def pair_frames(reference: DataFrame, candidate: DataFrame, keys: Sequence[str], shape: str = "shape") -> DataFrame:
    """Reference and candidate rows of the same key as ``r`` and ``c``; unequal shapes are marked.

    Rows carry the facts of a tensor and its path, not its values, so the join moves names only.
    """
    left = reference.select(*keys, F.struct(*[n for n in reference.columns if n not in keys]).alias("r"))
    right = candidate.select(*keys, F.struct(*[n for n in candidate.columns if n not in keys]).alias("c"))
    return left.join(right, list(keys)).withColumn("shape_differs", R.differs(F.col(f"r.{shape}"), F.col(f"c.{shape}")))


def lookup_candidate(points: DataFrame, contract: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Attach declared attributes; unknown ids and ids declared more than once are errors."""
    declared = contract.groupBy(key).agg(
        F.count("*").alias("_n"), *[F.min(a).alias(a) for a in attributes]
    )
    return points.join(declared, key, "left").withColumn(
        "errors",
        R.labels([("unknown candidate", F.col("_n").isNull()), ("candidate is declared more than once", F.col("_n") > 1)]),
    ).drop("_n")


def missing_and_unexpected(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, as ``missing`` or ``unexpected``."""
    have = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    want = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    both = have.join(want, list(keys), "full").filter(F.col("_a").isNull() | F.col("_e").isNull())
    return both.select(*keys, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("problem"))


def untracked(files: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Artifacts without a completed event."""
    return files.join(events.filter(F.col("status") == "completed"), list(keys), "left_anti")


def asset_lock_check(assets: DataFrame, lock: DataFrame, keys: Sequence[str] = ("kind", "variant")) -> DataFrame:
    """Assets against their lock rows: present, same hash, same size."""
    locked = lock.groupBy(*keys).agg(F.min(F.struct("sha256", "size_bytes")).alias("_lock"))
    found = F.col("_lock").isNotNull()
    return assets.join(locked, list(keys), "left").withColumn("errors", R.labels([
        ("no lock entry", ~found),
        ("size does not match lock", found & R.differs(F.col("size_bytes"), F.col("_lock.size_bytes"))),
        ("sha256 does not match lock", found & R.differs(F.col("sha256"), F.col("_lock.sha256"))),
    ])).drop("_lock")


def export_set_match(reported: DataFrame, files: DataFrame, group: Sequence[str]) -> DataFrame:
    """Two (path, sha256, size) sets per group must be equal; reported paths must not repeat."""
    keys = [*group, "path"]
    ours = reported.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("sha256", "size_bytes")).alias("_r"))
    theirs = files.groupBy(*keys).agg(F.min(F.struct("sha256", "size_bytes")).alias("_f"))
    both = ours.join(theirs, keys, "full")
    return both.groupBy(*group).agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_paths"),
        F.count_if(~F.col("_r").eqNullSafe(F.col("_f"))).alias("differences"),
    ).withColumn("matches", (F.col("duplicate_paths") == 0) & (F.col("differences") == 0))


def selection_matrix(workloads: DataFrame, key: str, variants: str, only_workload: str | None = None,
                     only_variant: str | None = None) -> DataFrame:
    """Workload and variant combinations, with optional filters."""
    rows = workloads.filter(F.col(key) == only_workload) if only_workload is not None else workloads
    out = rows.select(key, F.explode(variants).alias("variant"))
    return out.filter(F.col("variant") == only_variant) if only_variant is not None else out


def candidate_grid(contracts: DataFrame) -> DataFrame:
    """Candidates of each contract row: every stream count, plus a graph probe where allowed.

    Contract columns: implementation, minimum_streams, maximum_streams, probe_graph, auto_threads.
    """
    from fleetgauge.functions.scalars import candidate_id

    streams = F.explode(F.sequence("minimum_streams", "maximum_streams")).alias("num_streams")
    graphs = F.when(F.col("probe_graph"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    grid = contracts.select("*", streams).withColumn("cuda_graph", F.explode(graphs))
    return grid.withColumn(
        "candidate_id", candidate_id(F.col("implementation"), F.col("num_streams"), F.col("auto_threads"), F.col("cuda_graph"))
    )


def select_frames(frames: DataFrame, indices: DataFrame, column: str) -> DataFrame:
    """Frames whose index is declared; duplicates in the declaration have no effect."""
    return frames.join(indices.select(F.col(column)), column, "left_semi")


def frame_index_errors(indices: DataFrame, keys: Sequence[str], column: str, frame_count: Column) -> DataFrame:
    """Declared indexes outside [0, frame_count)."""
    return indices.withColumn("_limit", frame_count).groupBy(*keys).agg(
        F.count_if((F.col(column) < 0) | (F.col(column) >= F.col("_limit"))).alias("out_of_range")
    )


def winner_identity(digests: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether all implementations of a workload share one tensor digest and one output hash."""
    tensors = digests.groupBy(*keys).agg(
        (F.min("tensor_sha256") == F.max("tensor_sha256")).alias("tensors_identical"), F.min("tensor_sha256").alias("_t"))
    media = outputs.groupBy(*keys).agg(
        (F.min("output_sha256") == F.max("output_sha256")).alias("outputs_identical"), F.min("output_sha256").alias("_o"))
    return tensors.join(media, list(keys)).select(
        *keys, "tensors_identical", "outputs_identical",
        F.when(F.col("tensors_identical"), F.col("_t")).alias("tensor_sha256"),
        F.when(F.col("outputs_identical"), F.col("_o")).alias("output_sha256"),
    )


def verify_artifacts(references: DataFrame, digests: DataFrame) -> DataFrame:
    """Referenced artifacts exist, stay inside the root and keep their recorded hash."""
    stored = digests.groupBy("path").agg(F.min("sha256").alias("_now"))
    inside = R.path_contained(F.col("path"))
    return references.join(stored, "path", "left").withColumn("errors", R.labels([
        ("no artifact path", R.blank(F.col("path"))),
        ("artifact path escapes the root", ~R.blank(F.col("path")) & ~inside),
        ("artifact is missing", inside & F.col("_now").isNull()),
        ("artifact sha256 changed", inside & F.col("_now").isNotNull() & R.differs(F.col("sha256"), F.col("_now"))),
    ])).drop("_now")


# Check name -> column of decoded-output evidence.
EVIDENCE_FIELDS = {
    "workload": "workload_id", "variant": "variant", "encoder": "encoder",
    "input SHA256": "input_sha256", "ONNX SHA256": "onnx_sha256",
}


def evidence_set_errors(references: DataFrame, candidates: DataFrame, key: str, products: Sequence[str],
                        expected_frames: int, shared_engine: str | None = None) -> DataFrame:
    """Candidate outputs must be exactly ``products`` and agree with their reference.

    The product named ``shared_engine`` must also use the engine of the reference.  Both sides are
    dealt by counted rows, so that a task's memory does not grow with the tables, and products
    are flags of a set, not distinct values that every (key, product) would hold a place for.
    """
    parts = (references.count() + candidates.count()) // TASK_ROWS + 1
    references, candidates = references.repartition(parts, key), candidates.repartition(parts, key)
    fields = [*EVIDENCE_FIELDS.values(), "frames", "engine_sha256"]
    reference = references.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    rules = [(f"changed {label}", R.differs(F.col(f), F.col(f"_r_{f}"))) for label, f in EVIDENCE_FIELDS.items()]
    rules.append(("changed frame count", R.differs(F.col("frames"), F.lit(expected_frames))))
    if shared_engine is not None:
        rules.append(("changed the shared engine", (F.col("product") == shared_engine) & R.differs(F.col("engine_sha256"), F.col("_r_engine_sha256"))))
    judged = candidates.join(reference, key).withColumn("_changes", F.size(R.labels(rules)))
    known = F.coalesce(F.col("product").isin(*products), F.lit(False))
    per_set = judged.groupBy(key).agg(
        F.sum("_changes").alias("changes"), F.count("*").alias("_n"), F.count_if(~known).alias("_other"),
        *[F.bool_or(F.col("product") == p).alias(f"_has_{i}") for i, p in enumerate(products)],
    )
    exact = (F.col("_n") == len(products)) & (F.col("_other") == 0) & F.lit(len(set(products)) == len(products))
    for i in range(len(products)):
        exact = exact & F.col(f"_has_{i}")
    return references.select(key, "frames").join(per_set, key, "left").select(
        key, F.coalesce("changes", F.lit(0)).alias("changes"),
        R.labels([
            ("reference does not contain the expected frames", R.differs(F.col("frames"), F.lit(expected_frames))),
            ("candidates are not exactly the expected products", ~R.when_present(exact)),
        ]).alias("errors"),
    )


# --- sets -------------------------------------------------------------------------------


def set_equal(a: DataFrame, b: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Whether both sides hold the same keys, per group."""
    wrong = missing_and_unexpected(a, b, [*group, *keys]).groupBy(*group).agg(F.count("*").alias("_wrong"))
    groups = a.select(*group).union(b.select(*group)).distinct()
    return groups.join(wrong, list(group), "left").select(*group, F.col("_wrong").isNull().alias("equal"))


def missing_from(required: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys that were not found, each once."""
    return required.select(*keys).subtract(found.select(*keys))


def unexpected_artifacts(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(*keys).subtract(expected.select(*keys))


def dedup_ordered(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First occurrence of each key combination; combines map-side instead of ranking rows."""
    rest = F.struct(*[n for n in df.columns if n not in keys])
    return df.groupBy(*keys).agg(F.min_by(rest, order).alias("_first")).select(*keys, "_first.*")


def union_evidence(parts: dict[str, DataFrame]) -> DataFrame:
    """All stages below each other with a ``stage`` column."""
    frames = [df.withColumn("stage", F.lit(stage)) for stage, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def upsert_rejections(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rejections merged by candidate, the newer one wins."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [n for n in old.columns if n != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_age", *rest)).alias("_kept")).select(key, "_kept.*")


# --- order ------------------------------------------------------------------------------


def ordered_report(df: DataFrame, *order: str) -> DataFrame:
    """Deterministic output order; the remaining columns break ties."""
    return df.orderBy(*order, *[n for n in df.columns if n not in order])


def first_winner(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest composite key per group."""
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_w")).select(*keys, "_w.*")


def narrowest_subset(df: DataFrame, keys: Sequence[str], spread: str, rounds: str) -> DataFrame:
    """Subset with the smallest spread, ties by its rounds."""
    return first_winner(df, keys, [spread, rounds])
