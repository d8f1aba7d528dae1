"""Join, set and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import joins as jn
from fleetgauge.plans.manifests import errors_sql, joined
from fleetgauge.plans.registry import query

c = F.col


def sha(column):
    return F.sha2(column.cast("string"), 256)


@query("J01_pair_frames", """WITH e AS (SELECT vec_id // 2 AS frame_index, vec_id % 2 AS side, label, embedding[1] AS first FROM embeddings)
SELECT r.frame_index, r.label AS reference_label, x.label AS candidate_label, r.label % 3 <> x.label % 3 AS shape_differs FROM e r JOIN e x ON r.frame_index = x.frame_index AND r.side = 0 AND x.side = 1""")
def _j01(t):
    e = t.embeddings.select(
        F.floor(c("vec_id") / 2).cast("long").alias("frame_index"), (c("vec_id") % 2).alias("side"), "label",
        F.array(F.lit(3), c("label") % 3).alias("shape"), F.concat(c("vec_id").cast("string"), F.lit(".f32")).alias("path"))
    pairs = jn.pair_frames(e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side"), ["frame_index"])
    return pairs.select("frame_index", c("r.label").alias("reference_label"), c("c.label").alias("candidate_label"), "shape_differs")


@query("J02_lookup_candidate", f"""WITH d AS (SELECT p_brand || '-' || p_size AS id, count(*) AS n, min(p_type) AS kind FROM part WHERE p_size <= 45 GROUP BY 1)
SELECT p_partkey, kind, {errors_sql(('unknown candidate', 'n IS NULL'), ('candidate is declared more than once', 'n > 1'))} AS errors FROM part LEFT JOIN d ON d.id = p_brand || '-' || p_size""")
def _j02(t):
    p = t.part.withColumn("candidate_id", F.concat_ws("-", "p_brand", c("p_size").cast("string")))
    contract = p.filter("p_size <= 45").select("candidate_id", c("p_type").alias("kind"))
    return jn.lookup_candidate(p.select("p_partkey", "candidate_id"), contract, "candidate_id", ["kind"]).select("p_partkey", "kind", joined())


@query("J04_missing_and_unexpected", """SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN o_custkey IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def _j04(t):
    actual = t.orders.filter("o_orderstatus = 'P'").select(c("o_custkey").alias("custkey"))
    expected = t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("custkey"))
    return jn.missing_and_unexpected(actual, expected, ["custkey"])


@query("J05_untracked", """SELECT c_custkey AS custkey, c_name AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def _j05(t):
    files = t.customer.select(c("c_custkey").alias("custkey"), c("c_name").alias("path"))
    done = (c("o_orderstatus") == "F") & (c("o_orderpriority") == "1-URGENT")
    events = t.orders.select(c("o_custkey").alias("custkey"), F.when(done, "completed").otherwise("failed").alias("status"))
    return jn.untracked(files, events, ["custkey"])


@query("J15_asset_lock_check", f"""SELECT p_partkey, {errors_sql(('no lock entry', 'p_partkey % 7 = 0'), ('size does not match lock', 'p_partkey % 7 > 0 AND p_size > 40'),
 ('sha256 does not match lock', 'p_partkey % 7 > 0 AND p_partkey % 5 = 0'))} AS errors FROM part""")
def _j15(t):
    key = [c("p_type").alias("kind"), c("p_partkey").cast("string").alias("variant")]
    assets = t.part.select("p_partkey", *key, sha(c("p_name")).alias("sha256"), c("p_size").alias("size_bytes"))
    lock = t.part.filter("p_partkey % 7 > 0").select(
        *key, F.when(c("p_partkey") % 5 == 0, "x").otherwise(sha(c("p_name"))).alias("sha256"), F.least(c("p_size"), F.lit(40)).alias("size_bytes"))
    return jn.asset_lock_check(assets, lock).select("p_partkey", joined())


@query("J16_export_set_match", """WITH r AS (SELECT o_custkey AS g, o_orderpriority AS path, count(*) AS n, min((CASE WHEN o_orderkey % 40 = 0 THEN 'x' ELSE o_orderstatus END, o_custkey)) AS v FROM orders WHERE o_orderkey % 30 > 0 GROUP BY 1, 2),
s AS (SELECT o_custkey AS g, o_orderpriority AS path, min((o_orderstatus, o_custkey)) AS v FROM orders GROUP BY 1, 2)
SELECT s.g AS custkey, count(*) FILTER (r.n > 1) AS duplicate_paths, count(*) FILTER (r.v IS DISTINCT FROM s.v) AS differences,
 count(*) FILTER (r.n > 1) = 0 AND count(*) FILTER (r.v IS DISTINCT FROM s.v) = 0 AS matches FROM s LEFT JOIN r ON r.g = s.g AND r.path = s.path GROUP BY 1""")
def _j16(t):
    base = t.orders.select(c("o_custkey").alias("custkey"), c("o_orderpriority").alias("path"), "o_orderkey", "o_orderstatus", c("o_custkey").alias("size_bytes"))
    reported = base.filter("o_orderkey % 30 > 0").withColumn("sha256", F.when(c("o_orderkey") % 40 == 0, "x").otherwise(c("o_orderstatus")))
    files = base.withColumn("sha256", c("o_orderstatus"))
    return jn.export_set_match(reported, files, ["custkey"])


@query("J17_selection_matrix", """SELECT c_name AS workload, v.variant FROM customer, (VALUES ('720p'), ('1080p'), ('2160p')) v(variant) WHERE CASE WHEN c_custkey % 3 = 0 THEN v.variant = '720p' ELSE v.variant <> '2160p' END""")
def _j17(t):
    three = F.when(c("c_custkey") % 3 == 0, F.array(F.lit("720p"))).otherwise(F.array(F.lit("720p"), F.lit("1080p")))
    return jn.selection_matrix(t.customer.select(c("c_name").alias("workload"), three.alias("variants")), "workload", "variants")


@query("J18_candidate_grid", """WITH k AS (SELECT p_partkey, 'impl-' || p_partkey AS i, 1 + p_size % 3 AS lo, 3 + p_size % 6 AS hi, p_partkey % 2 = 0 AS g, p_partkey % 3 = 0 AS a FROM part),
s AS (SELECT *, unnest(range(lo, hi + 1)) AS n FROM k), q AS (SELECT *, unnest(CASE WHEN g THEN [false, true] ELSE [false] END) AS graph FROM s)
SELECT p_partkey, n AS num_streams, graph AS cuda_graph, i || '-s' || n || CASE WHEN a THEN '-tauto' ELSE '' END || '-g' || CAST(graph AS INTEGER) AS candidate_id FROM q""", num_streams="INTEGER")
def _j18(t):
    contracts = t.part.select(
        "p_partkey", F.concat(F.lit("impl-"), c("p_partkey").cast("string")).alias("implementation"), (1 + c("p_size") % 3).alias("minimum_streams"),
        (3 + c("p_size") % 6).alias("maximum_streams"), (c("p_partkey") % 2 == 0).alias("probe_graph"), (c("p_partkey") % 3 == 0).alias("auto_threads"))
    return jn.candidate_grid(contracts).select("p_partkey", "num_streams", "cuda_graph", "candidate_id")


@query("J19_select_frames", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _j19(t):
    return jn.select_frames(t.documents.select("doc_id", "source"), t.labels.filter("quality = 1"), "doc_id")


@query("J19b_frame_index_errors", "SELECT source, count(*) FILTER (n_chars >= 2000) AS out_of_range FROM documents GROUP BY 1")
def _j19b(t):
    return jn.frame_index_errors(t.documents, ["source"], "n_chars", F.lit(2000))


@query("J21_winner_identity", """WITH d AS (SELECT o_custkey AS workload, sha256(o_orderstatus) AS tt, sha256(CASE WHEN o_custkey % 2 = 0 THEN 'same' ELSE o_orderpriority END) AS oo FROM orders)
SELECT workload, min(tt) = max(tt) AS tensors_identical, min(oo) = max(oo) AS outputs_identical, CASE WHEN min(tt) = max(tt) THEN min(tt) END AS tensor_sha256, CASE WHEN min(oo) = max(oo) THEN min(oo) END AS output_sha256 FROM d GROUP BY 1""")
def _j21(t):
    key = c("o_custkey").alias("workload")
    digests = t.orders.select(key, sha(c("o_orderstatus")).alias("tensor_sha256"))
    outputs = t.orders.select(key, sha(F.when(c("o_custkey") % 2 == 0, "same").otherwise(c("o_orderpriority"))).alias("output_sha256"))
    return jn.winner_identity(digests, outputs, ["workload"])


@query("J24_verify_artifacts", f"""WITH r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' || page_id WHEN 2 THEN '../' || page_id ELSE 'p/' || page_id END AS path FROM pages),
q AS (SELECT *, path <> '' AND page_id % 5 > 2 AS ok FROM r)
SELECT page_id, {errors_sql(('no artifact path', "path = ''"), ('artifact path escapes the root', 'page_id % 5 IN (1, 2)'), ('artifact is missing', 'ok AND page_id % 4 = 0'), ('artifact sha256 changed', 'ok AND page_id % 4 > 0 AND page_id % 3 = 0'))} AS errors FROM q""")
def _j24(t):
    slot, key = c("page_id") % 5, c("page_id").cast("string")
    path = F.when(slot == 0, "").when(slot == 1, F.concat(F.lit("/"), key)).when(slot == 2, F.concat(F.lit("../"), key)).otherwise(F.concat(F.lit("p/"), key))
    refs = t.pages.select("page_id", path.alias("path"), sha(c("html")).alias("sha256"))
    now = t.pages.filter("page_id % 4 > 0").select(
        F.concat(F.lit("p/"), key).alias("path"), F.when(c("page_id") % 3 == 0, "changed").otherwise(sha(c("html"))).alias("sha256"))
    return jn.verify_artifacts(refs, now).select("page_id", joined())


@query("J25_evidence_set_errors", f"""
WITH r AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 900 ELSE 1000 END AS frames FROM orders),
x AS (SELECT l_orderkey AS k, l_returnflag AS product, l_linestatus AS enc, CASE WHEN l_linenumber = 7 THEN 10 ELSE 1000 END AS frames, l_suppkey % 3 AS eng FROM lineitem),
j AS (SELECT x.k, product, CAST(enc IS DISTINCT FROM o_orderstatus AS INTEGER) + CAST(x.frames <> 1000 AS INTEGER) + CAST(product = 'A' AND eng <> o_custkey % 3 AS INTEGER) AS ch FROM x JOIN r USING (k)),
g AS (SELECT k, sum(ch) AS changes, count(*) AS n, count(DISTINCT product) AS d, count(*) FILTER (product NOT IN ('A', 'R')) AS other FROM j GROUP BY 1)
SELECT r.k, CAST(coalesce(changes, 0) AS BIGINT) AS changes, {errors_sql(('reference does not contain the expected frames', 'r.frames <> 1000'), ('candidates are not exactly the expected products', 'NOT coalesce(n = 2 AND d = 2 AND other = 0, false)'))} AS errors FROM r LEFT JOIN g USING (k)""")
def _j25(t):
    same = [F.lit("x").alias(n) for n in ("workload_id", "variant", "input_sha256", "onnx_sha256")]
    refs = t.orders.select(
        c("o_orderkey").alias("k"), *same, c("o_orderstatus").alias("encoder"),
        F.when(c("o_orderkey") % 9 == 0, 900).otherwise(1000).alias("frames"), (c("o_custkey") % 3).alias("engine_sha256"))
    cands = t.lineitem.select(
        c("l_orderkey").alias("k"), *same, c("l_returnflag").alias("product"), c("l_linestatus").alias("encoder"),
        F.when(c("l_linenumber") == 7, 10).otherwise(1000).alias("frames"), (c("l_suppkey") % 3).alias("engine_sha256"))
    return jn.evidence_set_errors(refs, cands, "k", ["A", "R"], 1000, "A").select("k", "changes", joined())


@query("U01_set_equal", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_returnflag AS k FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_orderkey AS g, l_returnflag AS k FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT coalesce(x.g, y.g) AS g, coalesce(x.s = y.s, false) AS equal FROM (SELECT g, string_agg(k, ',' ORDER BY k) AS s FROM a GROUP BY g) x FULL JOIN (SELECT g, string_agg(k, ',' ORDER BY k) AS s FROM b GROUP BY g) y ON x.g = y.g""")
def _u01(t):
    # Odd lines of an order against its even lines.
    pick = lambda rest: t.lineitem.filter(c("l_linenumber") % 2 == rest).select(c("l_orderkey").alias("g"), c("l_returnflag").alias("k"))
    return jn.set_equal(pick(1), pick(0), ["g"], ["k"])


@query("U02_missing_from", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _u02(t):
    return jn.missing_from(t.documents, t.labels, ["doc_id"])


@query("U03_dedup_ordered", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def _u03(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey")
    return jn.dedup_ordered(rows, ["l_partkey", "l_suppkey"], c("l_orderkey"))


@query("U04_union_evidence", "SELECT 'reconnaissance' AS stage, o_orderkey, o_totalprice AS fps FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'confirmation', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def _u04(t):
    rows = t.orders.select("o_orderkey", c("o_totalprice").alias("fps"), "o_orderstatus", "o_orderpriority")
    keep = ["o_orderkey", "fps"]
    parts = {"reconnaissance": rows.filter("o_orderstatus <> 'F'").select(*keep), "confirmation": rows.filter("o_orderpriority = '1-URGENT'").select(*keep)}
    return jn.union_evidence(parts)


@query("U05_unexpected_artifacts", "SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def _u05(t):
    return jn.unexpected_artifacts(t.lineitem.select(c("l_partkey").alias("partkey")), t.part.filter("p_size < 25").select(c("p_partkey").alias("partkey")), ["partkey"])


@query("U06_upsert_rejections", """WITH o AS (SELECT o_custkey AS candidate, o_orderkey AS k, o_orderstatus AS reason FROM orders), a AS (SELECT candidate, 0 AS age, reason FROM o WHERE reason = 'F'), b AS (SELECT candidate, 1 AS age, reason FROM o WHERE reason <> 'F')
SELECT candidate, arg_max(reason, (age, reason)) AS reason FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def _u06(t):
    o = t.orders.select(c("o_custkey").alias("candidate"), c("o_orderstatus").alias("reason"))
    return jn.upsert_rejections(o.filter("reason = 'F'"), o.filter("reason <> 'F'"), "candidate")


@query("T01_ordered_report", "SELECT p_brand AS implementation, p_size AS streams, p_partkey FROM part ORDER BY 1, 2, 3")
def _t01(t):
    rows = t.part.select(c("p_brand").alias("implementation"), c("p_size").alias("streams"), "p_partkey")
    return jn.ordered_report(rows, "implementation", "streams")


@query("T02_first_winner", "SELECT p_brand, p_size, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_partkey) AS n FROM part) WHERE n = 1")
def _t02(t):
    rows = t.part.select("p_brand", "p_size", "p_type", "p_partkey")
    return jn.first_winner(rows, ["p_brand"], ["p_size", "p_type", "p_partkey"])


@query("T03_narrowest_subset", "SELECT l_suppkey, spread, rounds FROM (SELECT l_suppkey, l_discount + 0.0 AS spread, l_linenumber AS rounds, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount + 0.0, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _t03(t):
    rows = t.lineitem.select("l_suppkey", (c("l_discount") + 0.0).alias("spread"), c("l_linenumber").alias("rounds"))
    return jn.narrowest_subset(rows, ["l_suppkey"], "spread", "rounds")
