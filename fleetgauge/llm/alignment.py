"""Alignment of two tokenisers' ids over the bytes of the same texts.

Both tokenisers see the same bytes (a space and the text).  The cumulative ends of each side's
tokens are the keys of an end-to-index dictionary; the keys that both share, sorted, slice both
id lists into groups, and tokens of a slice whose ranges end with it are linked.

Texts are cut where both tokenisers always end a token: before a space or line end between two
characters that are not white space.  Between two cuts the alignment depends on that piece alone,
so a task aligns each distinct piece once and joins the results.

Work over the corpus: the aligned texts are written once with their distinct id pairs, pair
counts are summed per task and then by Spark, and the most frequent pairs (a bounded number)
travel to the tasks while the links of all others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.storage import saved
from fleetgauge.llm.words import row_groups, utf8

# Bounded parameters: pieces kept per task, pairs sent to every task, pair entries held before they are summed up.
CACHE_PIECES = 600_000
HEAD_PAIRS = 1_000_000
HELD_PAIRS = 1 << 21
LEARN_AT_ONCE = 4_000

# Resolution of the histogram of pair counts: buckets per doubling.
_STEPS = 16
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Ends that both sides share, and per shared end how many tokens of either side lie before it."""
    a_index, b_index = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    shared = sorted(a_index.keys() & b_index.keys())
    return shared, [a_index[end] for end in shared], [b_index[end] for end in shared]


class Aligner:
    """Pieces of texts with the alignment of both tokenisers, each distinct piece worked out once."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Bytes of the byte-level alphabet: a letter of it below 256 stands for its own byte, the others follow in order from 256 on.
        alphabet, spare = set(ByteLevel.alphabet()), 256
        byte_of = {}
        for byte in range(256):
            letter = chr(byte)
            if letter not in alphabet:
                letter, spare = chr(spare), spare + 1
            byte_of[letter] = byte
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode() for entry, i in entries.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id("▁")
        # Cuts are safe if the first tokeniser splits at white space and no piece of the second reaches over one.
        split = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(
            re.search("[^▁]▁|\n", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.loose: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.links, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _encoded(self, piece: str) -> tuple[list[int], list[int]]:
        """Ids of both tokenisers.  The second one puts a space before what it gets, which stands for the piece's own or is taken off again."""
        a = self.a.encode(piece, add_special_tokens=False).ids
        own = piece[:1] == " "
        b = self.b.encode(piece[1:] if own else piece)
        return a, b if own or not b or b[0] != self.b_space else b[1:]

    def _learn(self, pieces: list[str], known: dict[str, int]) -> None:
        """Align new pieces, many at a time: both sides end a token between two that begin and end with a word."""
        whole = [p for p in pieces if len(p) > 1 and not (p[1].isspace() or p[-1].isspace())]
        waiting = [whole[at:at + LEARN_AT_ONCE] for at in range(0, len(whole), LEARN_AT_ONCE)]
        if len(whole) < len(pieces):
            taken = set(whole)
            waiting += [[p] for p in pieces if p not in taken]
        sizes, good, links, order = [self.sizes], [self.good], [self.links], []
        while waiting:
            part = waiting.pop()
            raw = "".join(part).encode()
            a_ids, b_ids = self._encoded("".join(part))
            a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
            same = b"".join(a_parts) == raw == b"".join(b_parts)
            if not same and len(part) > 1:
                waiting += [[p] for p in part]
                continue
            a_ends, b_ends = (np.cumsum([len(x) for x in parts], dtype=np.int64) for parts in (a_parts, b_parts))
            shared, a_to, b_to = align(a_ends.tolist(), b_ends.tolist()) if same else ([], [], [])
            a_names, b_names = list(map(str, a_ids)), list(map(str, b_ids))
            groups = [f"{','.join(a_names[i:j])}|{','.join(b_names[k:n])}" for i, j, k, n in zip([0, *a_to], a_to, [0, *b_to], b_to)]
            ends = np.cumsum([len(p.encode()) for p in part])
            cuts = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, np.array(shared, np.int64))]
            edges = [0, *cuts[2].tolist()]
            self.texts += [";".join(groups[i:j]).encode() for i, j in zip(edges[:-1], edges[1:])]
            sizes.append(np.column_stack([np.diff(x, prepend=0) for x in (*cuts, cuts[2])]))
            good.append(np.full(len(part), same))
            if same:
                # No token is without bytes, so what ends together within a slice is its last token of either side.
                links.append(np.array(a_ids, np.int64)[np.array(a_to) - 1] << 32 | np.array(b_ids, np.int64)[np.array(b_to) - 1])
            order += part
        known.update(zip(order, range(len(self.good), len(self.good) + len(order))))
        self.sizes, self.good, self.links = np.concatenate(sizes), np.concatenate(good), np.concatenate(links)
        self.first = np.concatenate([[0], np.cumsum(self.sizes[:, 3])])

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """Slots of the pieces of every text, with what is new worked out."""
        if len(self.texts) > CACHE_PIECES:
            self._forget()
        cut, slow = [], []
        for n, text in enumerate(texts):
            if self.cuts and "\0" not in text:
                cut.append((" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:])
            else:
                cut.append([])
                slow.append(n)
        slots, fresh = self.slots, {}
        for pieces in cut:
            for piece in pieces:
                if piece not in slots and piece not in fresh:
                    # One word behind its separator; anything else needs the slow way.
                    fresh[piece] = len(piece) > 1 and piece[1:].split() == [piece[1:]]
        slots.update((piece, -1) for piece, plain in fresh.items() if not plain)
        self._learn([piece for piece, plain in fresh.items() if plain], slots)
        out = [[slots[piece] for piece in pieces] for pieces in cut]
        slow += [n for n, found in enumerate(out) if found and min(found) < 0]
        if slow:
            whole = {n: _SAFE_CUT.split(" " + texts[n]) if self.cuts else [" " + texts[n]] for n in slow}
            self._learn(list(dict.fromkeys(p for pieces in whole.values() for p in pieces if p not in self.loose)), self.loose)
            for n, pieces in whole.items():
                out[n] = [self.loose[p] for p in pieces]
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Numbers of ids, groups and links, the digest of the groups, and the distinct linked pairs with how often each occurs."""
        nothing = np.zeros(0, np.int64)
        for text, found in zip(texts, self._pieces([t or "" for t in texts])):
            slots = np.array(found, np.int64)
            if not text or not self.good[slots].all():
                yield (0, 0, 0, 0), "", nothing, nothing
                continue
            digest = hashlib.sha256()
            for at in range(0, len(found), 1 << 16):
                digest.update(b";" * (at > 0) + b";".join([self.texts[s] for s in found[at:at + (1 << 16)]]))
            starts, sizes = self.first[slots], self.first[slots + 1] - self.first[slots]
            edges = np.cumsum(sizes)
            links = self.links[np.repeat(starts - edges + sizes, sizes) + np.arange(int(edges[-1]))]
            yield tuple(self.sizes[slots].sum(0).tolist()), digest.hexdigest(), *np.unique(links, return_counts=True)


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a_path`` is a byte-level file of the ``tokenizers`` library, ``b_path`` a ``sentencepiece``
    model; both must lie at the same place on every executor.  Texts that are null or empty, or
    that either side does not give back byte for byte, have zeros and an empty digest.  Repeated
    rows count each, null ids stay, an empty table gives no rows, other columns are not read.
    ``head_pairs`` bounds what is sent to every task, not what is counted.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in row_groups(offsets):
                counts, digests, pairs, times = zip(*aligner.rows(batch.column("text").slice(a, b - a).to_pylist()))
                edges = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                flat, times = np.concatenate(pairs), np.concatenate(times)
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (flat >> 32, flat & 0xFFFFFFFF, times)]
                columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").slice(a, b - a), *columns, pa.array(digests, pa.string()), *lists], names=["i", *numbers, "digest", "a", "b", "n"])

    stored = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).mapInArrow(
        run, f"i {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, a array<int>, b array<int>, n array<int>")
    stored = saved(stored.withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = saved(_with_best(_pair_counts(stored)), "pairs")
    head_keys, head_counts, head_best = _head(pairs, head_pairs)
    sent = docs.sparkSession.sparkContext.broadcast((head_keys, head_counts, head_best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            edges = np.concatenate([[0], np.cumsum(batch.column("n").value_lengths().to_numpy())]).astype(np.int64)
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
            code = a << 32 | b
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            there = keys[at] == code if len(keys) else np.zeros(len(code), bool)
            where = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            total = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(total[0], where[there], n[there] * best[at[there]])
            np.add.at(total[1], where[there], n[there] * counts[at[there]])
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where[~there], minlength=batch.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~there], kind_)) for x, kind_ in ((code, pa.int64()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total[0]), pa.array(total[1]), *lists], names=["row", "n_best", "count_sum", "code", "n"])

    scored = stored.select("row", "a", "b", "n").mapInArrow(score, "row long, n_best long, count_sum long, code array<long>, n array<long>")
    scored = saved(scored, "head-scores")
    # Links of rarer pairs meet their counts in a join; both sides are spread by the pair.
    rare = scored.select("row", F.explode(F.arrays_zip("code", "n")).alias("e")).select("row", "e.code", "e.n")
    rare = rare.join(pairs.select("code", "count", "best"), "code")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    sums = scored.select("row", "n_best", "count_sum").join(rare, "row", "left")
    sums = sums.select("row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return stored.join(sums, "row").select(F.col("i").alias(doc_id), *numbers, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))


def _pair_counts(stored: DataFrame) -> DataFrame:
    """code, count over all links: summed inside tasks as often as memory asks for it, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, place, np.concatenate([x[1] for x in held]))
            return codes, total

        for batch in batches:
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
            held.append((a << 32 | b, n))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                held = [summed()]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["code", "part"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["code", "part"])

    parts = stored.select("a", "b", "n").mapInArrow(run, "code long, part long")
    return parts.groupBy("code").agg(F.sum("part").alias("count"))


def _with_best(pairs: DataFrame) -> DataFrame:
    """1 as ``best`` where no other pair of the same second id occurs more often."""
    second = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    pairs = pairs.withColumn("second", second)
    most = pairs.groupBy("second").agg(F.max("count").alias("most"))
    return pairs.join(most, "second").select("code", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _head(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, ``limit`` at most, by code: whole buckets of a histogram of counts, the largest counts first."""
    bucket = F.floor(F.log2("count") * _STEPS)
    left, least = limit, None
    for row in sorted(pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bucket):
        left -= row.n
        if left < 0:
            break
        least = row.bucket
    if least is None:
        return (np.zeros(0, np.int64),) * 3
    found = pairs.filter(bucket >= least).toArrow()
    order = np.argsort(found.column("code").to_numpy())
    return tuple(found.column(c).to_numpy()[order] for c in ("code", "count", "best"))
