"""URL rules by hashed expressions.

A rule is a host and a path prefix.  Every URL is expanded into the expressions of the shapes
that occur among the rules (how many host labels, how many path characters), expressions meet
rules in an equi-join on the first digits of their digests, and the full digests decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.storage import free

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_SHAPES = 10_000
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules``: host, path, action (``allow`` or ``block``).  A rule fits its host and all its
    subdomains when the URL's path starts with the rule's path.  The longest rule (host and path
    characters, then host) wins; of equal rules ``block`` wins.  Without a rule the verdict is
    ``default`` and ``rule`` is null; null URLs and URLs without ``://`` have empty host and path.
    Rules with a null part are left out.  Repeated rows come back as often as they came.
    """
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "action")
    labels = lambda host: F.size(F.split(host, r"\."))
    shapes = known.select(labels(F.col("r_host")).alias("k"), F.length("r_path").alias("m")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError("rules have too many shapes of host labels and path lengths")
    counted = known.groupBy("r_host", "r_path").agg(F.max("action").alias("action"))
    ruled = counted.select(
        F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
                 F.concat("r_host", "r_path").alias("rule"), "action").alias("found"),
        digest(F.col("r_host"), F.col("r_path")).alias("full"))
    ruled = ruled.withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    # Distinct URLs first: copies of one URL are judged once, and its rows meet the verdict afterwards.
    distinct = pages.select(F.col(url).alias("u")).distinct().select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    parts = [
        F.when((labels(F.col("h")) >= s["k"]) & (F.length("p") >= s["m"]) & (F.length("h") > 0),
               F.struct(F.substring_index("h", ".", -s["k"]).alias("host"), F.substring("p", 1, s["m"]).alias("path")))
        for s in shapes]
    none = F.array().cast("array<struct<host:string,path:string>>")
    expressions = distinct.select("u", F.explode(F.array_compact(F.array(*parts)) if parts else none).alias("x")).select(
        "u", digest(F.col("x.host"), F.col("x.path")).alias("full"))
    small = counted.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = expressions.withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).join(
        F.broadcast(ruled) if small else ruled, ["short"]).filter(expressions["full"] == ruled["full"])
    best = hits.groupBy("u").agg(F.max("found").alias("found"))
    host, path, rule, verdict = "host", "path", "rule", "verdict"
    clash = {host, path, rule, verdict} & {c.lower() for c in pages.columns}
    source = pages.drop(*[c for c in pages.columns if c.lower() in clash])
    found_url, found = free(source, "found_url", "found")
    best = best.select(F.col("u").alias(found_url), F.col("found").alias(found))
    return source.join(best, source[url] == F.col(found_url), "left").select(
        *[source[c] for c in source.columns], host_of(source[url]).alias(host), path_of(source[url]).alias(path),
        F.col(f"{found}.rule").alias(rule), F.coalesce(F.col(f"{found}.action"), F.lit(default)).alias(verdict))
