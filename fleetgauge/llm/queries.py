"""Registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import alignment, centroids, chat, decontamination, html, jaccard, mixing, neighbours, pii, quality, sharding, tokens, urls
from fleetgauge.session import use_utc

# Fixed values of the contract.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block")]
EXTRA_CONVERSATION, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_hits(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), decontamination.hit_words().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = urls.judge_urls(_table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_rows(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    segments = tokens.encode_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_documents(segments)


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(EXTRA_CONVERSATION, n, role, EXTRA_TEXT) for n, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(extra)))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(_table(spark, folder, "documents")))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extract_main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_vectors(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_sharding, op3_url_filters, op4_jaccard_join, op5_mixing, op6_token_output,
        op7_chat_formatting, op8_pii, op9_html_extraction, op10_quality_rules,
        op11_tokenizer_alignment, op12_nearest_neighbours, op13_centroid_clustering)}


_NORMAL = "[^\\x{0}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_NORMAL}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_NORMAL}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS s, least(13, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.k, g.i, v.item_id FROM grams g JOIN windows v ON g.k = v.k AND g.s = v.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = f"""
WITH rules(rhost, rpath, action) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {_ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT p.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS verdict
  FROM parts p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN best USING (page_id)
"""

OP4_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM doc UNION SELECT l.y, r.c FROM reach r JOIN link l ON l.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM doc d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP7_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONVERSATION}, n, r, '{EXTRA_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r)),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens,
    length(replace(replace(text, '\\', '\\s'), '<', '\\l')) AS chars,
    length(replace(replace(replace(role, '\\', '\\s'), '<', '\\l'), '>', '\\g')) AS role_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + sum(CASE WHEN opens THEN 15 + role_chars ELSE 6 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def _rounds_sql(rounds: int = 3) -> str:
    """Integer k-means of 16 centroids with its rounds written out."""
    steps = ["""kept AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", """long AS MATERIALIZED (
  SELECT r, d, list_extract(v, d) AS x FROM kept, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS d))""", """start AS MATERIALIZED (
  SELECT v, row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM kept)
  ORDER BY c LIMIT 16)""", "cent0 AS MATERIALIZED (SELECT c, d, list_extract(v, d) AS x FROM start, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS d))"]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT r, min(dist) AS dist, arg_min(c, (dist, c)) AS c FROM (
    SELECT r, c, CAST(sum((l.x - t.x) * (l.x - t.x)) AS BIGINT) AS dist FROM long l JOIN cent{n} t USING (d) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""cent{n + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(m.x, t.x) AS x FROM cent{n} t LEFT JOIN (
    SELECT c, d, CAST(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS x FROM near{n} JOIN long USING (r) GROUP BY c, d) m USING (c, d))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS s FROM cent{rounds} GROUP BY c) USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_url_filters": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op7_chat_formatting": OP7_SQL,
            "op13_centroid_clustering": _rounds_sql()}
