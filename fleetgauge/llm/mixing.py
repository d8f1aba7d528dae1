"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash.  Words are summed by source and hash bucket; the bucket in
which a source's budget ends is found from the running sums and alone refined by further hash
digits.  What remains is one threshold per source, and the mix is a filter: no document is
sorted or ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.storage import free, saved

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS = 4
DIGITS = 10  # bits of the hash that each level adds
SENT_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> target: shares of the total by weight, capped, the excess reshared.

    Sources by code point, null last, take ``weights`` in turn.  Sources are capped in order of
    source_size / weight; what the capped ones leave is shared by weight among the others, so
    the fill level is the first at which no further source is capped.  The input has one row
    per source.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(later))
    # The first source, in this order, whose cap lies above the level sets it for itself and all later ones.
    filled = filled.withColumn("_fill", F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(
        F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(everything)["_level"])
    return filled.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_fill") * F.col("_w"), F.col("_cap"))).alias("target"))


def _sent(per_source: DataFrame) -> DataFrame:
    """A table of one row per source, sent to every task if there are few; otherwise joined like any other."""
    return F.broadcast(per_source) if per_source.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES else per_source


def _digits(level: int) -> Column:
    """Hash digits of one level, highest first."""
    return F.shiftrightunsigned(F.col("hash"), 64 - DIGITS * (level + 1)).bitwiseAND(F.lit((1 << DIGITS) - 1))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, budget -> source, prefix: documents whose hash prefix is below ``prefix`` are taken.

    ``rows``: source, size, hash.  Each level sums the words of one bucket per source by
    2 ** DIGITS buckets and keeps the one where the budget ends.  The last bucket, a few
    documents, is taken whole when that comes nearer to the budget than leaving it out.
    """
    edge = budgets.select("source", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        mine = F.shiftrightunsigned(F.col("hash"), 64 - DIGITS * level) if level else F.lit(0).cast("long")
        inside = rows.join(_sent(edge.select(F.col("source").alias("s"), F.col("prefix").alias("p"))),
                           F.col("source").eqNullSafe(F.col("s")) & (mine == F.col("p")), "left_semi")
        sums = inside.groupBy("source", _digits(level).alias("bucket")).agg(F.sum("size").alias("words"))
        so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0))).withColumnRenamed("source", "s")
        # The bucket where the budget ends: the last one that starts at or below it.
        sums = sums.join(_sent(edge.select("source", "rest", "prefix")), F.col("s").eqNullSafe(F.col("source"))).filter(F.col("before") <= F.col("rest"))
        last = sums.groupBy("source").agg(F.max(F.struct("bucket", "before", "words", "rest", "prefix")).alias("b"))
        edge = last.select("source", (F.col("b.rest") - F.col("b.before")).alias("rest"),
                           (F.shiftleft(F.col("b.prefix"), DIGITS) + F.col("b.bucket")).alias("prefix"), F.col("b.words").alias("words"))
        edge = saved(edge, "mix-edge")
    whole = F.col("words") - F.col("rest") <= F.col("rest")
    return edge.select("source", (F.col("prefix") + F.when(whole, 1).otherwise(0)).alias("prefix"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row.

    A source whose target is k times its size and something is taken k times whole, and the
    documents below its threshold once more; copies never exceed ``cap``.  Null texts have no
    words; documents without words are taken with the same rule and add none.  The hash comes
    from id and text, so equal rows are taken together and reruns agree.  Sources are few (one
    row each is sorted and broadcast); documents are never sorted.
    """
    rows = saved(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(5), F.col(doc_id), F.col(text)).alias("hash")), "mix-rows")
    return _mixed(rows, weights, cap).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mixed(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = saved(targets, "mix-targets")
    edges = thresholds(rows, targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    plan = targets.withColumnRenamed("source", "s").join(
        _sent(edges.withColumnRenamed("source", "e")), F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    below = F.shiftrightunsigned(F.col("hash"), 64 - DIGITS * LEVELS) < F.coalesce(F.col("prefix"), F.lit(0))
    copies = F.least(F.col("whole") + F.when(below, 1).otherwise(0), F.lit(cap)).cast("long")
    return rows.join(_sent(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies).drop("s")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Documents of the mix: each row repeated as often as the mix takes it (or left out)."""
    hashed = F.xxhash64(F.lit(5), F.col(doc_id), F.col(text))
    rows = saved(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("hash")), "mix-rows")
    # One row per (source, hash): rows of equal hash are equal rows and share their number of copies.
    plan = _mixed(rows, weights, cap).select("source", "whole", "prefix").distinct()
    own = F.shiftrightunsigned(hashed, 64 - DIGITS * LEVELS)
    key, whole, prefix, copy = free(docs, "_source", "_whole", "_prefix", "_copy")
    plan = plan.select(F.col("source").alias(key), F.col("whole").alias(whole), F.coalesce("prefix", F.lit(0)).alias(prefix))
    copies = F.least(F.col(whole) + F.when(own < F.col(prefix), 1).otherwise(0), F.lit(cap)).cast("int")
    return (
        docs.join(_sent(plan), F.col(source).eqNullSafe(F.col(key)))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[docs[c] for c in docs.columns])
    )
