"""Token ids in compressed binary segments.

Documents are range-partitioned and sorted by id; every partition tokenises its texts as they
stream by and writes segments of about ``SEGMENT_IDS`` ids (``rangecoder``), cut between
documents.  A segment is a row of a Parquet table in the shared folder, so Spark's commit protocol
covers lost executors and no task writes files of its own.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.rangecoder import decode, encode
from fleetgauge.llm.storage import saved
from fleetgauge.llm.words import EXACT_VALUES, NOT_SPACE, mix64, row_groups, utf8, words

END_ID = 2
SEGMENT_IDS = 1 << 22
CACHE_WORDS = 1_000_000
_SEPARATED = mix64(np.arange(256, dtype=np.uint64))
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER[:0x80] = ~_LETTER[:0x80] & NOT_SPACE[:0x80]


def _after_letters(piece: np.ndarray) -> np.ndarray:
    """Where ASCII other than letters and white space follows a letter of ASCII or U+00C0 to U+00FF."""
    at = np.flatnonzero(_OTHER[piece])
    at = at[at > 0]
    before, lead = piece[at - 1], piece[np.maximum(at - 2, 0)]
    return at[_LETTER[before] | (lead == 0xC3) & (at > 1) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]


class _Places:
    """Numbers 0, 1, ... of 64-bit keys in the order they came, by open addressing in two arrays."""

    def __init__(self) -> None:
        self.count = 0
        self._make(1 << 16)

    def _make(self, places: int) -> None:
        self.mask, self.keys, self.numbers = places - 1, np.zeros(places, np.uint64), np.zeros(places, np.int32)

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or else the free place where its search ended."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held != 0)]
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, which are not 0; -1 for a key not added yet."""
        at = self._probe(keys)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct new keys get the next numbers."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > self.mask:
            there = np.flatnonzero(self.keys)
            keys, numbers = np.concatenate([self.keys[there], keys]), np.concatenate([self.numbers[there], numbers])
            self._make(1 << (2 * self.count).bit_length())
        while len(keys):
            at = self._probe(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys      # one of those that met at a free place
            self.numbers[at[won]] = numbers[won]
            keys, numbers = keys[~won], numbers[~won]


class Tokenizer:
    """Ids of texts by the ``tokenizers`` library, each distinct piece with its separator encoded once.

    Byte-level BPE never merges across its pre-tokens, and a single space or line end between two
    characters that are not white space always starts one.  So does an ASCII character that is no
    letter after a letter.  A text with no other white space is thus the concatenation of such
    pieces, each with the separator before it.  All other texts go to the library whole.  Pieces are
    known by 64-bit hashes.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.line_end = self._whole(["\n"])[0]
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = _Places()
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray) -> None:
        """Encode new pieces, many at once, with line ends between them as tokens of their own.

        A piece that follows a line end in its text takes the token of the one before it here.
        """
        starts = starts - (separators == 0x20)
        sizes = ends - starts + 1
        edge = np.concatenate([[0], np.cumsum(sizes)])
        text = data.take(np.repeat(starts - edge[:-1], sizes) + np.arange(edge[-1]), mode="clip")
        text[edge[1:] - 1] = 0x0A
        for at in range(0, len(starts), JOINED):
            last = min(at + JOINED, len(starts))
            ids = self._whole([text[edge[at]:edge[last]].tobytes().decode()])[0]
            cuts = np.flatnonzero(ids == self.line_end[0])
            if len(cuts) != last - at or cuts[-1] != len(ids) - 1:
                ids = np.concatenate([np.append(self._whole([text[edge[n]:edge[n + 1] - 1].tobytes().decode()])[0], self.line_end) for n in range(at, last)])
                cuts = np.flatnonzero(ids == self.line_end[0])
            begins = np.concatenate([[0], cuts[:-1] + 1]) + 1 - (separators[at:last] == 0x0A)
            self.starts = np.concatenate([self.starts, len(self.flat) + begins])
            self.sizes = np.concatenate([self.sizes, cuts + 1 - begins])
            self.flat = np.concatenate([self.flat, self.line_end, ids])
        self.known.add(keys)

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows with white space other than single spaces and line ends between pieces, or with a special token."""
        count = len(offsets) - 1
        odd = np.zeros(count, bool)
        inner = rows[1:] == rows[:-1]
        after, gap = ends[:-1][inner], (starts[1:] - ends[:-1])[inner]
        between = rows[1:][inner]
        odd[between[(gap > 1) | (gap == 1) & (data[after] != 0x20) & (data[after] != 0x0A)]] = True
        # Pieces must cover the row but for the separators between them.
        size = np.bincount(rows, weights=ends - starts, minlength=count) + np.bincount(between, weights=gap, minlength=count)
        odd |= size != np.diff(offsets)
        piece = data[offsets[0]:offsets[-1]]
        lead = np.flatnonzero((piece >= 0x1C) & (piece <= 0x1F) | (piece == 0xC2) | (piece >= 0xE1) & (piece <= 0xE3))
        if len(lead):
            b0, b1, b2 = (np.where(lead + k < len(piece), piece[np.minimum(lead + k, len(piece) - 1)], 0) for k in range(3))
            wide = (b0 < 0x20) | (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
            wide |= (b0 == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
            wide |= (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
            odd[np.searchsorted(offsets, lead[wide] + offsets[0], "right") - 1] = True
        raw = piece.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at + offsets[0], "right") - 1] = True
                at = raw.find(token, at + 1)
        return odd

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of UTF-8 ``data``."""
        if self.known.count > CACHE_WORDS:
            self._forget()
        rows, starts, ends, hashes = words(data, offsets, NOT_SPACE, EXACT_VALUES, _after_letters)
        count = len(offsets) - 1
        odd = self._odd_rows(data, offsets, rows, starts, ends) if len(rows) else np.diff(offsets) > 0
        if odd.any():
            plain = ~odd[rows]
            rows, starts, ends, hashes = rows[plain], starts[plain], ends[plain], hashes[plain]
        separators = data[np.maximum(starts, 1) - 1] if len(starts) else np.zeros(0, np.uint8)
        separators[(starts == offsets[rows]) | (separators != 0x20) & (separators != 0x0A)] = 0
        keys = hashes ^ _SEPARATED[separators]
        keys[keys == 0] = 1
        slot = self.known.find(keys)
        lacking = np.flatnonzero(slot < 0)
        if len(lacking):
            at = lacking[np.sort(np.unique(keys[lacking], return_index=True)[1])]
            self._learn(keys[at], data, starts[at], ends[at], separators[at])
            slot[lacking] = self.known.find(keys[lacking])
        sizes = self.sizes[slot]
        borders = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[slot] - borders + sizes, sizes) + np.arange(int(sizes.sum()))]
        edge = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=sizes, minlength=count).astype(np.int64))])
        out = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
        which = np.flatnonzero(odd)
        for row, found in zip(which, self._whole([data[offsets[r]:offsets[r + 1]].tobytes().decode() for r in which]) if len(which) else []):
            out[row] = found
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.rows(*utf8(pa.array(texts, pa.string())))


JOINED = 2000


def _kept(path: str) -> tuple[dict, tuple]:
    """What tasks of one Python worker leave each other, and the key of the tokenizer at ``path`` in it.

    The package travels by value, so its own globals are made anew for every task.
    """
    facts = os.stat(path)
    module = sys.modules.setdefault("fleetgauge_worker", ModuleType("fleetgauge_worker"))
    return module.__dict__.setdefault("tokenizers", {}), (path, facts.st_size, facts.st_mtime_ns)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
                     segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write all texts as segments; returns the stored table part, segment, n_ids, data, doc_ids, counts.

    Documents stand in ascending id order (null first; equal ids by text digest), each followed by
    ``end_id``.  Null and empty texts are just the end id; repeated rows are written as often as
    they come; an empty table gives no segments.
    """
    kind = docs.schema[doc_id].dataType
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = _kept(path)
        tokenizer = kept.pop(key, None) or Tokenizer(path)
        part, segment = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts = [len(h) for h in held]
            data = encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([sum(counts)], pa.int64()),
                pa.array([data], pa.binary()), pa.array([names], pa.list_(names_type)), pa.array([counts], pa.list_(pa.int64()))],
                names=["part", "segment", "n_ids", "data", "doc_ids", "counts"])

        for batch in batches:
            names_type = batch.schema.field("doc_id").type
            ids, (data, offsets) = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            for first, last in row_groups(offsets):
                for name, row in zip(ids[first:last], tokenizer.rows(data, offsets[first:last + 1])):
                    held.append(np.concatenate([row, end]))
                    names.append(name)
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flush()
                        held, names, size, segment = [], [], 0, segment + 1
        if held:
            yield flush()
        kept[key] = tokenizer  # only a task that came to its end hands it on

    schema = f"part int, segment int, n_ids long, data binary, doc_ids array<{kind.simpleString()}>, counts array<long>"
    return saved(ordered.mapInArrow(write, schema), "segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the segments."""
    kind = segments.schema["doc_ids"].dataType.elementType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data, names, counts in zip(*[batch.column(c) for c in ("part", "segment", "data", "doc_ids", "counts")]):
                ids = decode(data.as_py()).astype("<u4")
                borders = np.concatenate([[0], np.cumsum(counts.as_py())]).astype(np.int64)
                checks = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(borders[:-1], borders[1:])]
                rows = len(checks)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * rows, pa.int32()), pa.array([segment.as_py()] * rows, pa.int32()), names.values,
                    pa.array(borders[:-1], pa.int64()), pa.array(np.diff(borders), pa.int64()), pa.array(checks, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    # Segment starts in two steps: totals of partitions, then segments inside each.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("p"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    starts = segments.select("part", "segment", inside.alias("s")).join(parts, "part").select("part", "segment", (F.col("p") + F.col("s")).alias("base"))
    read_back = segments.select("part", "segment", "data", "doc_ids", "counts").mapInArrow(
        read, f"part int, segment int, doc_id {kind.simpleString()}, at long, n_tokens long, ids_crc32 long")
    return read_back.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
