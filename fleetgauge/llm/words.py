"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

Word classes that only exclude ASCII characters can be found on bytes: every byte of a longer
UTF-8 sequence is above 0x7F.  Texts are worked on in pieces of bounded size; a text longer
than a piece is cut between words, so memory does not follow its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
GROUP_BYTES = 1 << 21

# [^\x20\x09-\x0D]+ : everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# bytes.translate table that lower-cases A-Z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
LOWER_VALUES = _VALUES[np.frombuffer(LOWER, np.uint8)]
EXACT_VALUES = _VALUES

_powers: dict[str, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``size``, kept per worker."""
    have = _powers.get(str(base))
    if have is None or len(have) < size:
        factors = np.full(max(size, PIECE_BYTES + 1), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(factors)
    return have[:size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes (one longer row stands alone)."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def _pieces(data: np.ndarray, word: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    while stop - start > PIECE_BYTES:
        cut = start + PIECE_BYTES
        inside = word[data[start:cut]]
        gaps = np.flatnonzero(~inside[len(inside) // 2:])
        if len(gaps):
            cut = start + len(inside) // 2 + int(gaps[-1]) + 1
        else:
            while cut < stop and word[data[cut]]:
                cut += 1
        yield start, cut
        start = cut
    yield start, stop


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE, values: np.ndarray | None = LOWER_VALUES,
          cuts: Callable[[np.ndarray], np.ndarray] | None = None):
    """Row number, byte start, byte end and 64-bit hash of every word, in order.

    Rows are numbered from 0 for ``offsets[0]``.  Without ``values`` no hash is made.  ``cuts``
    gives the bytes inside words, but not their first, at which another word starts.
    """
    rows, starts, ends, hashes = [], [], [], []
    for a, b in _pieces(data, word, int(offsets[0]), int(offsets[-1])):
        if a == b:
            continue
        piece = data[a:b]
        inside = word[piece]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        if cuts is not None:
            cut = cuts(piece)
            opens[cut] = True
            closes[cut - 1] = True
        borders = offsets[(offsets > a) & (offsets < b)] - a
        opens[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if values is not None:
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values[piece] * _power(_PRIME, len(piece)), out=total[1:])
            hashes.append(mix64((total[e] - total[s]) * _power(_INVERSE, len(piece) + 1)[s] + (e - s).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, s + a, "right") - 1)
        starts.append(s + a)
        ends.append(e + a)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)


def windows(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words that stays inside a row."""
    n = len(rows) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(_PRIME) + hashes[k:k + n]
    keep = rows[:n] == rows[size - 1:]
    return rows[:n][keep], mix64(total[keep])


def shingles(rows: np.ndarray, hashes: np.ndarray, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per row, sorted by row and hash: (row offsets of length count + 1, hashes).

    A row with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    at, value = windows(rows, hashes, size)
    per_row = np.bincount(rows, minlength=count)
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):
        first = np.searchsorted(rows, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = k < per_row[short]
            step = total * np.uint64(_PRIME) + hashes[np.minimum(first + k, len(hashes) - 1)]
            total = np.where(there, step, total)
        total = mix64(total ^ mix64(per_row[short].astype(np.uint64)))
        at, value = np.concatenate([at, short]), np.concatenate([value, total])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    borders = np.searchsorted(at, np.arange(count + 1))
    for row in range(count):
        value[borders[row]:borders[row + 1]].sort()
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1])
    at, value = at[new], value[new]
    return np.searchsorted(at, np.arange(count + 1)), value
