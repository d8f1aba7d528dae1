"""Context-mixing range coder for token ids.

A segment is coded in parts of about ``PART_IDS`` ids.  A part begins with a checked table of its
distinct ids and how often each comes; ids are coded as places in that table.  Its ids are cut
into blocks; the adaptive state starts anew in each, so with the table any block can be decoded
alone, and each carries a checksum.  Per id three predictions are mixed: the id last seen after the
two ids before (order 2), after the one before (order 1), and the frequencies of the part (order 0).
Adaptive shares, chosen by whether orders 2 and 1 were right the last time, say how the code
range is divided among them, so one step of the coder writes an id of any kind.

All blocks of a part advance together, one id per block and step, so every operation is a
numpy operation over the blocks; a shorter last block ends at its own last id.  Checksums cover
the headers, the tables and the coded bytes, so nothing of a damaged segment is decoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
PART_IDS = 1 << 21
MAGIC = b"CMRC3\n"
_HEAD, _PART, _BLOCK = "<I", "<IIII", "<II"  # parts; blocks, ids per block, distinct ids, table bytes; ids, bytes
_SCALE = 16                       # probabilities are shares of 1 << 16
_ONE = 1 << _SCALE
_SLOTS2, _SLOTS1 = 2048, 1024     # table sizes of the contexts, per block
_CONTEXTS = 8
_RATE, _LEAST, _GAIN = 5, 4, 1916  # shares move by 1/32 and stay from 128 to 61,471, so no interval is empty
# Both shares of a context are one number, order 2 in the upper half.  By twice "order 1 was right" plus
# "order 2 was right": what moves (order 1 is judged only where order 2 was wrong) and what is gained.
_BOTH, _UPPER = 0x07FFFFFF07FFFFFF, 0x07FFFFFF00000000
_MOVES = np.array([_BOTH, _UPPER, _BOTH, _UPPER])
_GAINS = np.array([_LEAST << 32 | _LEAST, (_LEAST + _GAIN) << 32, _LEAST << 32 | (_LEAST + _GAIN), (_LEAST + _GAIN) << 32])
_LOOKUP = 20                      # order-0 scales up to this are looked up, larger ones searched
_U = np.uint64
_WORD, _HALF = _U(32), _U(1 << 32)


class _Frequencies:
    """Order-0 intervals of the distinct ids of a part, as shares of ``1 << bits``; none is empty."""

    def __init__(self, counts: np.ndarray) -> None:
        distinct = len(counts)
        self.bits = min(max(_SCALE, (16 * distinct - 1).bit_length()), 24)
        size = 1 + counts * ((1 << self.bits) - distinct) // int(counts.sum())
        self.size, self.start = size.astype(_U), (np.cumsum(size) - size).astype(_U)

    def finder(self):
        """A function that gives the place in the table for values of the scale."""
        if self.bits > _LOOKUP:
            return lambda value: np.searchsorted(self.start, value, "right") - 1
        places = np.repeat(np.arange(len(self.size), dtype=np.uint32), self.size.astype(np.int64))
        return lambda value: places.take(value.view(np.int64), mode="clip").astype(np.int64)


class _Model:
    """Predictions and adaptive shares of ``lanes`` blocks side by side.

    A context of order 2 or 1 holds twice the id seen last after it, plus 1 if that id had been
    foretold.  The two such bits and whether both guess the same choose among eight pairs of
    adaptive shares per block.  Arrays are reused from step to step.
    """

    def __init__(self, lanes: int) -> None:
        row = np.arange(lanes)
        self.row2, self.row1, self.rows = row * _SLOTS2, row * _SLOTS1, row * _CONTEXTS
        self.table2, self.table1 = np.zeros(lanes * _SLOTS2, np.int32), np.zeros(lanes * _SLOTS1, np.int32)
        self.shares = np.full(lanes * _CONTEXTS, (_ONE // 4) << 32 | _ONE // 4, np.int64)
        self.carried, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.held2, self.held1 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.g2, self.g1 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.slot2, self.slot1, self.state, self.context, self.pair, self.a, self.p1, self.b, self.t = (np.zeros(lanes, np.int64) for _ in range(9))
        self.apart, self.hit1 = np.zeros(lanes, bool), np.zeros(lanes, bool)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the intervals: [0, a) order 2, [a, b) order 1, [b, 2**16) order 0."""
        t, slot2, slot1, context = self.t, self.slot2, self.slot1, self.context
        np.multiply(self.last, 10007, out=slot2)
        slot2 += self.carried
        slot2 >>= 3
        slot2 &= _SLOTS2 - 1
        slot2 += self.row2
        np.bitwise_and(self.last, _SLOTS1 - 1, out=slot1)
        slot1 += self.row1
        self.table2.take(slot2, out=self.held2, mode="clip")
        self.table1.take(slot1, out=self.held1, mode="clip")
        np.right_shift(self.held2, 1, out=self.g2)
        np.right_shift(self.held1, 1, out=self.g1)
        np.not_equal(self.g1, self.g2, out=self.apart)
        self.held2 &= 1
        self.held1 &= 1
        self.held2 <<= 2
        self.held1 <<= 1
        self.held2 |= self.held1
        self.held2 |= self.apart
        np.add(self.rows, self.held2, out=context)
        self.shares.take(context, out=self.pair, mode="clip")
        np.right_shift(self.pair, 32, out=self.a)
        np.bitwise_and(self.pair, 0xFFFFFFFF, out=self.p1)
        np.subtract(_ONE, self.a, out=t)
        t *= self.p1
        t >>= _SCALE
        t *= self.apart
        np.add(self.a, t, out=self.b)
        return self.a.view(_U), self.b.view(_U)

    def learn(self, ids: np.ndarray, hit2: np.ndarray) -> None:
        """Takes up the ids of one step (32-bit places); ``hit2`` says where the order-2 guess was right."""
        t, state, hit1 = self.t, self.state, self.hit1
        np.equal(ids, self.g1, out=hit1)
        np.copyto(t, hit2)
        np.copyto(state, hit1)
        state += state
        state |= t
        np.right_shift(self.pair, _RATE, out=t)
        _MOVES.take(state, out=self.a, mode="clip")
        t &= self.a
        self.pair -= t
        _GAINS.take(state, out=t, mode="clip")
        self.pair += t
        self.shares[self.context] = self.pair
        np.left_shift(ids, 1, out=self.held2)
        np.bitwise_or(self.held2, hit1, out=self.held1)
        self.held2 |= hit2
        self.table2[self.slot2] = self.held2
        self.table1[self.slot1] = self.held1
        np.multiply(self.last, 40503, out=self.carried)
        self.last[:] = ids


def _pack(facts: bytes, data: bytes) -> bytes:
    return facts + struct.pack("<I", zlib.crc32(data, zlib.crc32(facts))) + data


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, part_ids: int = PART_IDS) -> bytes:
    """One segment: blocks of ``block_ids`` ids below 2**32, each with its size and CRC-32."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must lie in [0, 2**32)")
    step = max(-(-len(ids) // (max(round(len(ids) / part_ids), 1) * block_ids)), 1) * block_ids  # parts of like size
    parts = [_encode_part(ids[at:at + step], block_ids) for at in range(0, len(ids), step)]
    return MAGIC + _pack(struct.pack(_HEAD, len(parts)), b"") + b"".join(parts)


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, how often each comes, and where each id stands among them."""
    if ids.max() < 1 << 20:
        often = np.bincount(ids)
        known = np.flatnonzero(often)
        place = np.zeros(len(often), np.int32)
        place[known] = np.arange(len(known))
        return known, often[known], place[ids]
    known, place, often = np.unique(ids, return_inverse=True, return_counts=True)
    return known, often, place.astype(np.int32)


def _encode_part(ids: np.ndarray, block_ids: int) -> bytes:
    known, often, place = _places(ids)
    lanes, steps = -(-len(ids) // block_ids), min(block_ids, len(ids))
    listed = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes() + often.astype("<u4").tobytes(), 1)
    head = _pack(struct.pack(_PART, lanes, block_ids, len(known), len(listed)), listed)
    tail = len(ids) - (lanes - 1) * block_ids
    table = np.zeros(lanes * steps, np.int32)
    table[:len(ids)] = place
    by_step = np.ascontiguousarray(table.reshape(lanes, steps).T)
    order0 = _Frequencies(often)
    model, bits = _Model(lanes), _U(order0.bits)
    low, span = np.zeros(lanes, _U), np.full(lanes, 2 ** 64 - 1, _U)
    unit, at_a, at_b, start, size = (np.zeros(lanes, _U) for _ in range(5))
    words = np.zeros(lanes * (steps + 2), np.uint32)      # an id settles one word at most
    first = np.arange(lanes) * (steps + 2)
    at = first.copy()
    hit2, hit1, small = (np.zeros(lanes, bool) for _ in range(3))
    last = b""

    def coded(n: int) -> bytes:
        return words[first[n]:at[n]].astype("<u4").tobytes() + struct.pack("<II", int(low[n]) >> 32, int(low[n]) & 0xFFFFFFFF)

    for t in range(steps):
        if t == tail:
            last = coded(lanes - 1)                       # what follows in this lane is not kept
        now = by_step[t]
        a, b = model.predict()
        np.equal(now, model.g2, out=hit2)
        np.equal(now, model.g1, out=hit1)
        np.right_shift(span, _U(_SCALE), out=unit)
        np.multiply(unit, a, out=at_a)
        np.multiply(unit, b, out=at_b)
        # Order 0 first, then the lanes that a guess was right about.
        unit <<= _U(_SCALE)
        unit -= at_b
        unit >>= bits
        order0.start.take(now, out=start, mode="clip")
        order0.size.take(now, out=size, mode="clip")
        start *= unit
        start += at_b
        size *= unit
        at_b -= at_a
        np.greater(hit1, hit2, out=hit1)
        np.copyto(start, at_a, where=hit1)
        np.copyto(size, at_b, where=hit1)
        np.copyto(start, _U(0), where=hit2)
        np.copyto(size, at_a, where=hit2)
        low += start
        np.less(low, start, out=small)
        who = small.nonzero()[0]
        if len(who):
            over = at[who] - 1
            while len(over):
                words[over] += np.uint32(1)
                over = over[words[over] == 0] - 1
        span, size = size, span
        np.less(span, _HALF, out=small)
        who = small.nonzero()[0]
        if len(who):
            some = low[who]
            words[at[who]] = some >> _WORD
            low[who] = some << _WORD
            span[who] <<= _WORD
            at += small
        model.learn(now, hit2)
    blocks = [coded(n) for n in range(lanes)]
    if last:
        blocks[-1] = last
    sizes = [block_ids] * (lanes - 1) + [tail]
    return head + b"".join(_pack(struct.pack(_BLOCK, size, len(data)), data) for size, data in zip(sizes, blocks))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def checked(self, layout: str, what: str, sized: bool = True) -> tuple:
        """Numbers of ``layout`` and the bytes that follow, as many as the last number says."""
        begin = self.at + struct.calcsize(layout) + 4
        if begin > len(self.data):
            raise ValueError("the segment is cut short")
        facts, check = self.data[self.at:begin - 4], self.data[begin - 4:begin]
        found = struct.unpack(layout, facts)
        self.at = begin + (found[-1] if sized else 0)
        body = self.data[begin:self.at]
        if len(body) < self.at - begin or check != struct.pack("<I", zlib.crc32(body, zlib.crc32(facts))):
            raise ValueError(f"{what} is damaged")
        return *found, body


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; whatever is damaged or cut off raises ``ValueError``."""
    data = bytes(data)
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a segment")
    reader = _Reader(data)
    reader.at = len(MAGIC)
    parts = []
    for _ in range(reader.checked(_HEAD, "the head of the segment", False)[0]):
        lanes, block_ids, distinct, _, listed = reader.checked(_PART, "the head of a part")
        blocks = [reader.checked(_BLOCK, f"block {n}") for n in range(lanes)]
        parts.append((block_ids, distinct, listed, blocks))
    if reader.at != len(data):
        raise ValueError("bytes follow the last block")
    return np.concatenate([_decode_part(*part) for part in parts]) if parts else np.zeros(0, np.uint32)


def _decode_part(block_ids: int, distinct: int, listed: bytes, blocks: list[tuple]) -> np.ndarray:
    facts = np.frombuffer(zlib.decompress(listed), "<u4").astype(np.int64)
    known, order0 = np.cumsum(facts[:distinct]).astype(np.uint32), _Frequencies(facts[distinct:])
    find, bits, highest = order0.finder(), _U(order0.bits), _U((1 << order0.bits) - 1)
    sizes, streams = [size for size, _, _ in blocks], [np.frombuffer(coded, "<u4") for _, _, coded in blocks]
    lanes = len(sizes)
    steps = sizes[0]
    width = max(map(len, streams)) + 1
    words = np.zeros((lanes, width), _U)
    for n, stream in enumerate(streams):
        words[n, :len(stream)] = stream
    code = (words[:, 0] << _WORD) | words[:, 1]
    at = np.arange(lanes) * width + 2
    words = words.ravel()
    span = np.full(lanes, 2 ** 64 - 1, _U)
    unit, at_a, at_b, start = (np.zeros(lanes, _U) for _ in range(4))
    hit2, guessed, small = (np.zeros(lanes, bool) for _ in range(3))
    by_step = np.zeros((steps, lanes), np.int32)
    model = _Model(lanes)
    for t in range(steps):
        now = by_step[t]
        a, b = model.predict()
        np.right_shift(span, _U(_SCALE), out=unit)
        np.multiply(unit, a, out=at_a)
        np.multiply(unit, b, out=at_b)
        unit <<= _U(_SCALE)
        unit -= at_b
        unit >>= bits
        np.less(code, at_a, out=hit2)
        np.less(code, at_b, out=guessed)
        np.copyto(now, model.g1)
        np.copyto(now, model.g2, where=hit2)
        miss = (~guessed).nonzero()[0]
        np.subtract(at_b, at_a, out=span)
        np.copyto(span, at_a, where=hit2)
        np.copyto(start, at_a)
        np.copyto(start, _U(0), where=hit2)
        if len(miss):
            one, base = unit[miss], at_b[miss]
            value = (code[miss] - base) // one
            np.minimum(value, highest, out=value)
            found = find(value)
            now[miss] = found
            start[miss] = base + one * order0.start[found]
            span[miss] = one * order0.size[found]
        code -= start
        np.less(span, _HALF, out=small)
        who = small.nonzero()[0]
        if len(who):
            # A lane that has ended goes on over zeros or what follows; its ids are dropped below.
            code[who] = code[who] << _WORD | words.take(at[who], mode="clip")
            span[who] <<= _WORD
            at += small
        model.learn(now, hit2)
    table = known[by_step.T]
    return np.concatenate([table[:-1].ravel(), table[-1, :sizes[-1]]])
