"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark is a stated query set: its items are normalised into words and cut into blocks
of a bounded number of words, and one automaton is built per block.  Training texts stream
through it word by word; the automaton tracks the longest match that ends at each word.
Documents are never shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.storage import free, small_batches

WINDOW = 13
BLOCK_WORDS = 50_000

# Lower-cases A-Z, keeps 0-9, a-z and every byte of a character beyond ASCII, blanks the rest.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(NORMAL).split()


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``report`` says what a match means.

    A window is ``size`` consecutive words of an item; a shorter item is one window.  Per state:
    ``wide`` is the set of items (a bit each) that hold the last ``size`` words of a match, and
    ``whole`` lists the short items that end a match, longest first.
    """

    def __init__(self, items: list[list[bytes]], size: int) -> None:
        self.size = size
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, held = [-1], [0], [0]
        short: dict[int, list[int]] = {}
        for number, sequence in enumerate(items):
            last = 0
            for word in sequence:
                last = self._extend(last, word, held)
                held[last] |= 1 << number
        for number, sequence in enumerate(items):
            if 0 < len(sequence) < size:
                state = 0
                for word in sequence:
                    state = self.next[state][word]
                short.setdefault(state, []).append(number)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                held[self.link[state]] |= held[state]
        self.wide, self.whole = [0] * len(self.link), [()] * len(self.link)
        for state in order:
            parent = self.link[state]
            if self.length[state] >= size:
                self.wide[state] = self.wide[parent] or held[state]
            lengths = {len(items[n]) for n in short.get(state, ())}
            own = tuple((k, sum(1 << n for n in short[state] if len(items[n]) == k)) for k in sorted(lengths, reverse=True))
            self.whole[state] = own + self.whole[parent]
        self.least = min([size, *(len(s) for s in items if s)], default=size)

    def _extend(self, last: int, word: bytes, held: list[int]) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, word, held)
        new = self._state(self.length[last] + 1, {}, held)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            target = self.next[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, target, word, held)
        return new

    def _state(self, length: int, moves: dict[bytes, int], held: list[int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        held.append(0)
        return len(self.link) - 1

    def _split(self, state: int, target: int, word: bytes, held: list[int]) -> int:
        copy = self._state(self.length[state] + 1, dict(self.next[target]), held)
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], int, int]:
        """Hit word ranges (merged, end exclusive), the items with a window here, the longest match."""
        moves, link, length, wide, whole = self.next, self.link, self.length, self.wide, self.whole
        size, least, start = self.size, self.least, self.next[0]
        state = matched = longest = items = 0
        found: list[list[int]] = []
        for at, word in enumerate(words):
            to = moves[state].get(word) if state else start.get(word)
            if to is None:
                if not state:
                    continue
                while state and to is None:
                    state = link[state]
                    to = moves[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            if matched < least:
                continue
            reach = 0
            if matched >= size:
                reach = size
                items |= wide[state]
            for k, bits in whole[state]:
                if k <= matched:
                    items |= bits
                    reach = max(reach, k)
            if reach:
                first = at + 1 - reach
                while found and found[-1][1] >= first:
                    first = min(first, found.pop()[0])
                found.append([first, at + 1])
        return found, items, longest


def item_blocks(benchmark: DataFrame, item: str, text: str, size: int, block_words: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Benchmark items in blocks of about ``block_words`` words, one block on the driver at a time.

    Items longer than a block are cut into parts that overlap by ``size - 1`` words, which keeps
    every window.
    """
    ids: list = []
    parts: list[list[bytes]] = []
    held = 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        sequence = normal_words((row["t"] or "").encode())
        step = max(block_words - size + 1, 1)
        for at in range(0, max(len(sequence) - size + 1, 1), step):
            part = sequence[at:at + step + size - 1]
            if held and held + len(part) > block_words:
                yield ids, parts
                ids, parts, held = [], [], 0
            ids.append(row["i"])
            parts.append(part)
            held += len(part)
    if parts:
        yield ids, parts


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
])


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
              window: int = WINDOW, block_words: int = BLOCK_WORDS, out: str = "hits") -> DataFrame:
    """Every row of ``docs`` with struct ``out``: n_words, spans (word ranges), items, longest_match.

    Null and empty texts have no words and no spans; null or empty items match nothing and null
    item ids are left out of ``items``; repeated items count once per id.  Extra columns pass
    through; ``out`` must not be one of them.  Memory per task is one automaton block plus one
    Arrow batch.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out} already")
    spark = docs.sparkSession
    small_batches(spark)
    blocks = []
    for ids, parts in item_blocks(benchmark, item, item_text, window, block_words):
        names = [None if i is None else str(i) for i in ids]
        blocks.append(spark.sparkContext.broadcast(pickle.dumps((names, parts))))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, HITS)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One automaton is built once where the benchmark fits in a block; else one at a time per batch.
        ready = [_automaton(blocks[0].value, window)] if len(blocks) == 1 else None
        for batch in batches:
            texts = batch.column(text)
            results = [{"n_words": 0, "spans": [], "items": set(), "longest_match": 0} for _ in range(len(texts))]
            for number in range(max(len(blocks), 1)):
                names, automaton = (ready[0] if ready else _automaton(blocks[number].value, window)) if blocks else ([], None)
                for result, value in zip(results, texts):
                    raw = value.as_py()
                    words = normal_words(raw.encode()) if raw else []
                    result["n_words"] = len(words)
                    if automaton is None or not words:
                        continue
                    spans, items, longest = automaton.spans(words)
                    result["longest_match"] = max(longest, result["longest_match"])
                    if spans:
                        result["spans"] += spans
                    while items:
                        low = items & -items
                        result["items"].add(names[low.bit_length() - 1])
                        items ^= low
            for result in results:
                result["spans"] = merged(result["spans"])
                result["items"] = sorted(i for i in result["items"] if i is not None)
            hits = pa.array(results, type=_ARROW_HITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, out])

    return docs.mapInArrow(stream, schema)


_ARROW_HITS = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest_match", pa.int64())])


def _automaton(payload: bytes, window: int) -> tuple[list, SuffixAutomaton]:
    names, parts = pickle.loads(payload)
    return names, SuffixAutomaton(parts, window)


def hit_words(hits: str = "hits"):
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(hits: str = "hits", share: float = 0.05):
    """True where hit words are at least ``share`` of all words (and there is one), compared in integers."""
    exact = Fraction(str(share))
    return (hit_words(hits) > 0) & (hit_words(hits) * exact.denominator >= F.col(f"{hits}.n_words") * exact.numerator)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: float = 0.05,
                  span_words: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Clean documents: those at or over ``share`` hit words go.

    ``span_words``: hit spans of at least so many words are also cut out of the texts that stay.
    Other rows and columns come back as they are; null and empty texts stay.
    """
    (out,) = free(docs, "hits")
    found = find_hits(docs, benchmark, text, window=window, block_words=block_words, out=out)
    kept = found.filter(~F.coalesce(contaminated(out, share), F.lit(False)))
    if span_words is not None:
        cut = F.udf(lambda value, spans: _without(value, spans, span_words), "string", useArrow=True)
        kept = kept.withColumn(text, F.when(F.exists(f"{out}.spans", lambda s: s[1] - s[0] >= span_words),
                                            cut(text, F.col(f"{out}.spans"))).otherwise(F.col(text)))
    return kept.select(*docs.columns)


def _without(value: str, spans, least: int) -> str:
    import re

    raw = value.encode()
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    kept, at = [], 0
    for first, last in spans:
        if last - first >= least:
            kept.append(raw[at:places[first][0]])
            at = places[last - 1][1]
    return b"".join([*kept, raw[at:]]).decode()
