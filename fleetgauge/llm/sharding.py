"""Sharding by longest-processing-time scheduling.

Groups that must stay together (rows with equal texts) are sorted by size and go one by one to
the least-loaded shard, through a heap.  The heap sees a bounded number of entries whatever the
number of groups: every group above ``total / entries`` (at most ``entries`` of them can exist)
is an entry of its own, and the others are dealt by hash into ``entries`` bundles.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.storage import free, saved

SHARDS = 24
ROW_BYTES = 8
ENTRIES = 16_384
SLOT_ROWS = 50_000


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def least_loaded(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of every (size, name): largest first, each to the least-loaded shard, ties by shard number."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[name] = shard
    return out


def assign_shards(rows: DataFrame, group: str, size: str, shards: int = SHARDS, entries: int = ENTRIES, out: str = "shard") -> DataFrame:
    """Add int ``out``: rows of one non-null ``group`` (a 64-bit key) share a shard.

    Loads differ by no more than the largest entry: a group above ``total / entries`` or a bundle.
    ``rows`` is read several times, so it should be a stored narrow table.
    """
    spark = rows.sparkSession
    big, bundle, name = free(rows, "big", "bundle", "entry")
    groups = rows.groupBy(F.col(group).alias("g")).agg(F.sum(size).alias("s"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    limit = total / entries
    deal = F.pmod(F.xxhash64(F.lit(17), F.col("g")), F.lit(entries))
    wide = groups.select(
        "s", F.when(F.col("s") > limit, F.concat(F.lit("g"), F.col("g"))).otherwise(F.concat(F.lit("b"), deal)).alias("e"))
    # At most ``entries`` groups exceed the limit and there are ``entries`` bundles.
    loads = [(r["s"], r["e"]) for r in wide.groupBy("e").agg(F.sum("s").alias("s")).collect()]
    placed = least_loaded(loads, shards)
    singles = spark.createDataFrame([(int(k[1:]), v) for k, v in placed.items() if k[0] == "g"], f"{big} long, {out} int")
    bundles = spark.createDataFrame([(int(k[1:]), v) for k, v in placed.items() if k[0] == "b"], f"{bundle} long, {name} int")
    own = F.pmod(F.xxhash64(F.lit(17), F.col(group)), F.lit(entries))
    return (
        rows.join(F.broadcast(singles), F.col(group) == F.col(big), "left")
        .join(F.broadcast(bundles), own == F.col(bundle), "left")
        .withColumn(out, F.coalesce(F.col(out), F.col(name)))
        .drop(big, bundle, name)
    )


def number_slots(rows: DataFrame, shard: str, order: list[str], out: str = "slot", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add long ``out``: gapless positions from 0 within each shard, in no task more than about ``slot_rows`` rows.

    Each shard is cut by hash of ``order`` into parts; a part starts where the counts of the
    parts before it end.  Repeated rows get slots of their own.
    """
    part, base = free(rows, "part", "base")
    parts = max(rows.count() // slot_rows, 1)
    cut = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(shard, part).count().select(
        shard, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(shard, part).orderBy(*order)
    return (
        cut.repartition(shard, part).withColumn(out, F.row_number().over(inside).cast("long") - 1)
        .join(starts, [shard, part]).withColumn(out, F.col(out) + F.col(base)).drop(part, base)
    )


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: sizes (UTF-8 bytes plus 8) near equal, equal texts together, so a group of
    copies larger than its share makes its shard larger.  A null text has no bytes, CRC 0, and
    stays with the other nulls; rows with a null id are placed like others; an empty table gives
    no rows.  Slots follow no meaning beyond being gapless.
    """
    key = F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))
    narrow = saved(docs.select(
        F.col(doc_id).alias("doc_id"), (text_bytes(text) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), key.alias("_group")), "shard-rows")
    placed = assign_shards(narrow, "_group", "size", shards)
    slotted = number_slots(placed, "shard", ["doc_id", "_group"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
