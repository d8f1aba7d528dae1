"""Evidence sets against pairs in Python; tasks keep their size."""

from pyspark.sql import functions as F

from fleetgauge.operators import joins as jn

SAME = ("workload_id", "variant", "input_sha256", "onnx_sha256")


def sides(spark, refs, cands):
    same = [F.lit("x").alias(n) for n in SAME]
    r = spark.createDataFrame(refs, "k long, encoder string, frames int, engine_sha256 string").select("*", *same)
    return r, spark.createDataFrame(cands, "k long, product string, encoder string, frames int, engine_sha256 string").select("*", *same)


def test_evidence_sets_with_repeated_and_null_rows(spark, monkeypatch):
    refs = [(1, "e", 10, "g"), (2, "e", 9, "g"), (3, "e", 10, "g"), (3, "f", 10, "g"), (4, "e", 10, "g"), (5, "e", 10, "g"), (6, "e", 10, "g"), (None, "e", 10, "g"), (7, None, 10, "g")]
    cands = [(1, "A", "e", 10, "g"), (1, "R", "e", 10, "h"), (2, "A", "e", 10, "h"), (2, "A", "d", 9, "g"), (3, "A", "e", 10, "g"), (3, "R", "e", 10, "g"),
             (4, "A", "e", 10, "g"), (4, None, "e", 10, "g"), (5, "A", "e", 10, "g"), (5, "R", "e", 10, "g"), (5, "R", "e", 10, "g"), (7, "A", None, None, "g"), (7, "R", "e", 10, "g"),
             (8, "A", "e", 10, "g"), (None, "A", "e", 10, "g")]
    want = []
    for k, _, frames, _ in refs:
        pairs = [(r, c) for r in refs for c in cands if k is not None and r[0] == k == c[0]]
        changes = sum((c[2] != r[1]) + (c[3] != 10) + (c[1] == "A" and c[4] != r[3]) for r, c in pairs)
        exact = sorted(str(c[1]) for _, c in pairs) == ["A", "R"]
        want.append((k, changes, ["reference does not contain the expected frames"] * (frames != 10) + ["candidates are not exactly the expected products"] * (not exact)))
    for rows in (500_000, 2):
        monkeypatch.setattr(jn, "TASK_ROWS", rows)
        out = jn.evidence_set_errors(*sides(spark, refs, cands), "k", ["A", "R"], 10, "A")
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {tuple(r.errors) for r in jn.evidence_set_errors(*sides(spark, refs[:1], cands[:2]), "k", ["A", "A"], 10).collect()} == {
        ("candidates are not exactly the expected products",)}


def test_evidence_tasks_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(jn, "TASK_ROWS", 100)
    same = [F.lit("x").alias(n) for n in (*SAME, "encoder", "engine_sha256")]
    refs = spark.range(400).select(F.col("id").alias("k"), *same, F.lit(10).alias("frames"))
    cands = spark.range(800).select((F.col("id") % 400).alias("k"), F.when(F.col("id") < 400, "A").otherwise("R").alias("product"), *same, F.lit(10).alias("frames"))
    out = jn.evidence_set_errors(refs, cands, "k", ["A", "R"], 10)
    per_task = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 400 and max(r["count"] for r in per_task) <= 100
    assert out.filter("changes > 0 OR size(errors) > 0").isEmpty()
