"""Set-similarity join on word n-grams with several global token orders.

Linked sets (Jaccard at or above the threshold) must share a token among the first
``n - ceil(t * n) + 1`` tokens of each, under any order of all tokens.  The first order, rare
tokens before frequent ones, gives the candidates; a second order and a bound from 1,024-bit
parity maps are intersected with it before whole sets are compared.

Candidate buckets are never expanded into all their pairs.  Every bucket first compares its
members with a few leaders (minima of the scrambled ids, so no sort).  What leaders leave open
is compared in blocks by parity maps inside tasks, only between members not yet connected,
and only pairs that the maps cannot rule out become rows.  Both steps together lose no link
between different components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.components import connected_components, near_labels
from fleetgauge.llm.storage import free, saved, small_batches
from fleetgauge.llm.words import mix64, row_groups, shingles, utf8, words

SHINGLE_WORDS = 4
PERCENT = 85
# Counters of the frequency table: about one per word of all texts, within these bounds.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 25
BYTES_PER_COUNTER = 6
CHUNK = 1 << 15
MAP_LONGS = 16
LEADERS = 8
BLOCK = 256
BROADCAST_IDS = 1_000_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _sets(batch: pa.RecordBatch, text: str, size: int):
    """Row range, set offsets and sorted distinct shingles, a few megabytes of text at a time."""
    data, offsets = utf8(batch.column(text))
    for first, last in row_groups(offsets):
        rows, _, _, hashes = words(data, offsets[first:last + 1])
        borders, values = shingles(rows, hashes, last - first, size)
        yield first, last, borders, values


def _counter(values: np.ndarray, counters: int) -> np.ndarray:
    return (values >> np.uint64(20)).astype(np.int64) & (counters - 1)


def frequency_levels(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Rough frequency class of every token counter, from all texts: two classes per doubling.

    The table has about as many counters as there are words, 32 MB of classes at most, and is
    summed chunk by chunk on the executors.  A task counts a shingle up to 255.
    """
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    counters = min(max(1 << int(length // BYTES_PER_COUNTER).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint8)
        for batch in batches:
            for _, _, _, values in _sets(batch, text, size):
                place, times = np.unique(_counter(values, counters).astype(np.uint32), return_counts=True)
                total[place] = np.minimum(total[place] + times, 255).astype(np.uint8)
        for at in range(0, counters, CHUNK):
            part = total[at:at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at // CHUNK], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                totals.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                totals[chunk] += np.frombuffer(zlib.decompress(counts), np.uint8)
        for chunk, counts in totals.items():
            classes = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([classes.tobytes()], pa.binary())})

    parts = docs.select(text).mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    levels = np.zeros(counters, np.uint8)
    for row in parts.collect():  # counters / CHUNK rows, one byte per counter
        levels[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return levels


def _lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, kind))


def profiles(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, n, id (hash of the set; null for an empty one), first (prefix under order 1), second, parity."""
    kind = docs.schema[doc_id].dataType
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, text, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for lo, hi, borders, values in _sets(batch, text, size):
                n = np.diff(borders)
                reach = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                edges = np.concatenate([[0], np.cumsum(reach)])
                first, second = np.empty(edges[-1], np.uint64), np.empty(edges[-1], np.uint32)
                parity = np.zeros((hi - lo, MAP_LONGS), np.uint64)
                ids = np.zeros(hi - lo, np.uint64)
                other = mix64(values ^ _SECOND)
                ranks = level[_counter(values, len(level))]
                bit = (other & np.uint64(MAP_LONGS * 64 - 1)).astype(np.int64)
                summed = mix64(values)
                for row in range(hi - lo):
                    a, b, k = borders[row], borders[row + 1], reach[row]
                    if a == b:
                        continue
                    rank = ranks[a:b]
                    mine = np.argsort(rank, kind="stable")[:k]
                    first[edges[row]:edges[row + 1]] = values[a:b][mine]
                    # The second order: frequency class again, then another hash.
                    key = (rank.astype(np.uint64) << np.uint64(56)) | (other[a:b] >> np.uint64(8))
                    second[edges[row]:edges[row + 1]] = np.partition(key, k - 1)[:k].astype(np.uint32)
                    odd = np.bincount(bit[a:b], minlength=MAP_LONGS * 64) & 1
                    parity[row] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
                    ids[row] = summed[a:b].sum() ^ np.uint64(b - a)
                ids = mix64(ids).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(doc_id).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.int64(), mask=n == 0),
                    _lists(first.view(np.int64), edges, pa.int64()), _lists(second.view(np.int32), edges, pa.int32()),
                    _lists(parity.reshape(-1).view(np.int64), np.arange(hi - lo + 1) * MAP_LONGS, pa.int64())],
                    names=["doc_id", "n", "id", "first", "second", "parity"])

    schema = f"doc_id {kind.simpleString()}, n long, id long, first array<long>, second array<int>, parity array<long>"
    return saved(docs.select(doc_id, text).mapInArrow(describe, schema), "profiles")


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Smallest intersection of linked sets of sizes n and m: ceil(t / (1 + t) * (n + m))."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _members(pairs: DataFrame) -> DataFrame:
    """Distinct ids of pairs (a, b), each side reduced before the two meet."""
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, sent to every task where it is small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _near(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that sizes, parity maps and the second order leave open."""
    def filtered(some: DataFrame, column: str, passes) -> DataFrame:
        """``some`` pairs where ``passes`` holds; only sets in a pair are looked up, one column at a time."""
        wanted = _sent(saved(_members(some), "wanted"))
        known = saved(table.select("id", "n", column).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "looked-up")
        side = lambda s: known.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col(column).alias(f"{column}_{s}"))
        return saved(some.join(side("a"), "a").join(side("b"), "b").filter(passes).select("a", "b"), "near-pairs")

    differing = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    n, m = F.col("n_a"), F.col("n_b")
    near = filtered(pairs, "parity", _sizes_fit(n, m, percent) & (n + m - differing >= 2 * _least_overlap(n, m, percent)))
    return filtered(near, "second", F.arrays_overlap("second_a", "second_b"))


def _exact(near: DataFrame, table: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links, by their whole sets."""
    # Whole sets only of one document per set that takes part in a remaining pair.
    ids = saved(_members(near), "wanted")
    chosen = saved(table.select("id", "doc_id").filter("doc_id IS NOT NULL").join(_sent(ids), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "chosen")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(_sent(chosen.select("doc_id")), "doc_id", "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, borders, values in _sets(batch, "text", size):
                ids = [mix64(np.array([mix64(values[a:b]).sum() ^ np.uint64(b - a)], np.uint64)).view(np.int64)[0] for a, b in zip(borders[:-1], borders[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(values.view(np.int64), borders, pa.int64())], names=["id", "tokens"])

    found = texts.mapInArrow(whole, "id long, tokens array<long>")
    # Sets that only rows without an id have are taken from those rows.
    unnamed = ids.join(chosen, "id", "left_anti")
    if not unnamed.isEmpty():
        nameless = docs.filter(F.col(doc_id).isNull()).select(F.col(text).alias("text")).mapInArrow(whole, "id long, tokens array<long>")
        found = found.unionByName(nameless.join(unnamed, "id", "left_semi"))
    # Whole sets travel to the first set of each pair: that one once, the others once a pair.
    near = _sent(near)
    far = found.join(near, F.col("id") == F.col("b")).select("a", "b", F.col("tokens").alias("t"))
    own = found.join(near.select("a").distinct(), F.col("id") == F.col("a"), "left_semi").select(F.col("id").alias("a"), F.col("tokens").alias("s")).dropDuplicates(["a"])
    common = F.size(F.array_intersect("s", "t"))
    return far.join(own, "a").filter(common * 100 >= (F.size("s") + F.size("t") - common) * percent).select("a", "b")


def _unconnected(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of the pairs whose ends the links do not connect yet (as far as a few steps show)."""
    labels = near_labels(links, 3)
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _spread_blocks(rows: DataFrame) -> DataFrame:
    """Rows (token, id, n, label) dealt to block pairs: (token, left, right, side, ...).

    In each bucket the rows of the most common label need no comparison among themselves, so they
    only meet blocks of the others.
    """
    per_label = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
    top = per_label.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"))
    top = top.filter(F.col("all") > F.col("top.k")).select(
        "token", F.col("top.label").alias("major"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("majors"),
        F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("minors"))
    joined = rows.join(top, "token").withColumn("is_major", F.col("label") == F.col("major"))
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    joined = joined.withColumn("own", F.when(F.col("is_major"), F.col("minors") + own).otherwise(own))
    others = F.when(F.col("is_major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    return joined.withColumn("other", F.explode(others)).select(
        "token", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "id", "n", "label")


def _compare_blocks(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in ("token", "left", "right")]
            ids, n, label = (table.column(c).to_numpy() for c in ("id", "n", "label"))
            tokens = table.column("tokens").combine_chunks()
            parity = table.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, MAP_LONGS)
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            found_a, found_b = [], []
            for s, e in zip([0, *change], [*change, len(ids)]):
                for i in range(s, e - 1):
                    j = np.arange(i + 1, e)
                    j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
                    if not len(j):
                        continue
                    apart = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1)
                    least = np.ceil((n[j] + n[i]) * percent / (100 + percent) - 1e-9)
                    j = j[n[j] + n[i] - apart >= 2 * least]
                    if len(j):
                        # A pair is reported in the first of the buckets it shares only.
                        earlier = tokens[i].values.to_numpy()
                        j = np.array([x for x in j if not len(np.intersect1d(earlier, tokens[int(x)].values.to_numpy(), True))], np.int64)
                    found_a.append(np.full(len(j), ids[i]))
                    found_b.append(ids[j])
            a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
            b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["x", "y"])

        for batch in batches:
            # Sorted input: all but the last block pair of what is held is complete.
            table = pa.Table.from_batches([*held, batch])
            keys = [table.column(c).to_numpy() for c in ("token", "left", "right")]
            same = np.logical_and.reduce([k == k[-1] for k in keys]) if len(table) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0
            if cut:
                yield settle(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(map(len, held)):
            yield settle(pa.Table.from_batches(held))

    return compare


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id) per row and the links (a, b) between set ids that connect every component."""
    small_batches(docs.sparkSession)
    table = profiles(docs, doc_id, text, size, percent)
    postings = table.filter("n > 0").select("id", "n", F.explode("first").alias("token"))
    # Tokens of at least two different sets; minima and maxima combine map-side, so copies cost nothing.
    shared = postings.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("token")
    members = saved(postings.join(shared, "token", "left_semi").distinct(), "members")
    masks = [0, -1, *[int(x) for x in mix64(np.arange(1, LEADERS - 1, dtype=np.uint64)).view(np.int64)]]
    leads = members.groupBy("token").agg(
        F.count("*").alias("k"), *[F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"l{i}") for i, m in enumerate(masks)])
    leads = saved(leads.select("token", "k", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("leads")), "leaders")
    pairs = saved(_pairs(members.join(leads, "token").select(F.col("id").alias("x"), F.explode("leads").alias("y")).filter("x <> y")), "pairs")
    check = lambda some: saved(_exact(some, table, docs, doc_id, text, size, percent), "links")
    near = _near(pairs, table, percent)
    # One pair per set first: it settles most of a group of near copies, whose other pairs need no comparison then.
    one = saved(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    links = check(one)
    others = saved(_unconnected(near.join(one, ["a", "b"], "left_anti"), links), "other-pairs")
    links = saved(links.unionByName(check(others)), "links")
    # Buckets where some pair met no leader.
    labels = near_labels(links, 3)
    open_buckets = leads.filter(F.col("k") - 1 > F.size("leads")).select("token")
    rest = members.join(open_buckets, "token").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rest = saved(rest.select("token", "id", "n", "label"), "rest")
    blocks = _spread_blocks(rest)
    held = rest.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # no more than the prefix of one set
    maps = table.select("id", "parity").join(held, "id").dropDuplicates(["id"])
    # Of the tokens only those before the row's own can hold a pair that was reported earlier.
    dealt = blocks.join(maps, "id").withColumn("tokens", F.filter("tokens", lambda x: x < F.col("token")))
    dealt = dealt.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
    late = dealt.mapInArrow(_compare_blocks(percent), "x long, y long")
    late = saved(_pairs(late).join(pairs, ["a", "b"], "left_anti"), "late-pairs")
    if not late.isEmpty():
        links = saved(links.unionByName(check(_near(late, table, percent))), "all-links")
    return table.select("doc_id", "n", "id"), links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct ``size``-word
    shingles, with fewer words the whole sequence.  Null, empty and blank texts have the empty
    set, link with nothing and are components of their own.  Equal sets share a component;
    repeated rows stay.  Rows with a null id have a component too; its number is the smallest
    id that is not null (null where there is none).
    """
    rows, links = similar_sets(docs, doc_id, text, size, percent)
    found = connected_components(links)
    placed = rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Sums per set first, so that a large group of copies is one row before the join.
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the one with the smallest id, nulls last, and of equal rows one.

    Rows without words link with nothing and all stay.  Rows whose id is null or repeated are told
    apart by their sets, so an id with several texts loses only those that have a representative.
    """
    rows, links = similar_sets(docs, doc_id, text, size, percent)
    found = connected_components(links)
    groups = saved(rows.filter("id IS NOT NULL").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    best = saved(groups.groupBy("component").agg(F.min(place).alias("best")), "best")
    shared = saved(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_shared")), "shared-ids")
    losers = groups.join(best, "component").filter("doc_id IS NOT NULL AND NOT best.doc_id <=> doc_id").select("doc_id")
    gone = saved(losers.union(shared).distinct().select(F.col("doc_id").alias("_gone")), "gone")
    fits = lambda df: F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df
    own, gone_id, shared_id = free(docs, "_own", "_gone_id", "_shared_id")
    named = docs.filter(docs[doc_id].isNotNull())
    kept = named.join(fits(gone.select(F.col("_gone").alias(gone_id))), F.col(doc_id) == F.col(gone_id), "left_anti")
    # What the id alone does not tell: rows of null and of repeated ids.
    special = docs.filter(docs[doc_id].isNull())
    if not shared.isEmpty():
        special = special.unionByName(named.join(fits(shared.select(F.col("_shared").alias(shared_id))), F.col(doc_id) == F.col(shared_id), "left_semi"))
    elif special.isEmpty():
        return kept
    names = special.columns
    kinds = T.StructType([*special.schema.fields, T.StructField(own, T.LongType())])

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, borders, values in _sets(batch, text, size):
                sums = [mix64(np.array([mix64(values[a:b]).sum() ^ np.uint64(b - a)], np.uint64)).view(np.int64)[0] for a, b in zip(borders[:-1], borders[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, pa.array(sums, pa.int64(), mask=np.diff(borders) == 0)], names=[*names, own])

    told = special.mapInArrow(with_set, kinds)
    first, second = free(told, "_best_id", "_best_set")
    winners = best.select(F.col("best.doc_id").alias(first), F.col("best.id").alias(second))
    stay = told.join(winners, F.col(doc_id).eqNullSafe(F.col(first)) & (F.col(own) == F.col(second)), "left_semi").dropDuplicates([doc_id, own])
    return kept.unionByName(told.filter(F.col(own).isNull()).unionByName(stay).select(*names))
