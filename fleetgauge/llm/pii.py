"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans.  The field labels words (outside, or begin/inside of a kind)
and finds what patterns miss: telephone numbers without a plus sign, masked e-mail addresses,
spelled-out separators.  It is trained on a small labelled table and decoded by Viterbi over
batches of word sequences.  Plain words far from digits and signs are outside by definition,
so only the sequences around the others are decoded.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.words import NOT_SPACE, row_groups, utf8, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
DIMENSIONS = 1 << 11
REACH = 2         # plain words on each side of a marked word that belong to its sequence
TRAIN_ROWS = 600  # bound of the labelled table
EPOCHS = 150
BATCH = 4096      # sequences decoded at once
PIECE = 4096      # words of one long sequence whose scores are held at once

# The contract's patterns.  E-mail is matched from its at sign, so long runs without one cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    """Letters as a or A, digits as 0 (runs of up to four kept, longer ones as 0+), signs as they are."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word)
    out = re.sub(r"[0-9]{5,}", "0+", out)
    return re.sub(r"[0-9]", "0", out)[:40]


def _own(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'<>|")
    n = len(_digits(core))
    low = core.lower()
    return (f"s={shape(core)}", f"d={n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 20 else 20}", f"@={'@' in core}",
            f"w={low if low in CUES else ''}", f"b={core[:1] if core[:1] in '([{+' else ''}", f"p={core.count('.')}", f"h={core.count('-')}",
            f"x={any(c.isalpha() for c in core) and n > 0}")


# Words whose form itself is evidence; marked ones also start a sequence to decode.
CUES = frozenset("(at) [at] {at} (dot) [dot] {dot} at dot tel phone call fax mobile mail email e-mail ip host card".split())
_MARKED = np.zeros(256, bool)
_MARKED[list(b"0123456789@([{")] = True


def features(sequence: list[str]) -> np.ndarray:
    """Feature numbers per word, hashed: of the word, its left and its right neighbour."""
    own = [_own(w) for w in sequence]
    edge = ("edge",) * 8
    rows = []
    for at in range(len(sequence)):
        before, after = (own[at - 1] if at else edge), (own[at + 1] if at + 1 < len(own) else edge)
        names = [*own[at], *[f"<{f}" for f in before[:4]], *[f">{f}" for f in after[:4]], "bias"]
        rows.append([zlib.crc32(f.encode()) % DIMENSIONS for f in names])
    return np.array(rows, np.int64)


def labelled_rows(limit: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, labels), written from a rule.

    Personal data of every kind in plain, masked and local forms stands between filler words;
    look-alikes (versions, hashes, amounts, dates, order numbers) are labelled outside.
    """
    random = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda a=3, b=8: "".join(letters[i] for i in random.integers(0, 26, random.integers(a, b)))
    number = lambda n: "".join(str(i) for i in random.integers(0, 10, n))
    top = lambda: ("com", "org", "net", "de", "fr")[random.integers(0, 5)]
    octet = lambda: str(random.integers(1, 255))
    fillers = lambda n: [name(1, 9) + ("", "", "", ".", ",")[random.integers(0, 5)] for _ in range(n)]
    personal = [
        ("email", lambda: [f"{name()}.{number(2)}@{name()}.{name()}.{top()}"]), ("email", lambda: [f"{name()}@{name()}.{top()}"]),
        ("email", lambda: [name(), "(at)", f"{name()}.{top()}"]), ("email", lambda: [name(), "[at]", name(), "[dot]", top()]),
        ("email", lambda: [f"{name()}(at){name()}.{top()}"]), ("email", lambda: [f"{name()}[at]{name()}[dot]{top()}"]),
        ("ip", lambda: [".".join(octet() for _ in range(4))]),
        ("card", lambda: [number(16)]), ("card", lambda: [number(4) for _ in range(4)]), ("card", lambda: ["-".join(number(4) for _ in range(4))]),
        ("phone", lambda: [f"+{random.integers(1, 99)}", f"({number(3)})", f"{number(3)}-{number(4)}"]),
        ("phone", lambda: [f"({number(3)})", f"{number(3)}-{number(4)}"]), ("phone", lambda: [f"({number(3)}){number(3)}-{number(4)}"]),
        ("phone", lambda: [f"{number(3)}-{number(3)}-{number(4)}"]), ("phone", lambda: [f"({number(3)})", number(3), number(4)]),
    ]
    other = [
        lambda: [number(random.integers(1, 5))], lambda: [f"{random.integers(0, 9)}.{random.integers(0, 99)}."], lambda: ["version", f"{random.integers(0, 9)}.{random.integers(0, 20)}.{random.integers(0, 9)}"],
        lambda: ["token", "=", '"' + "".join("0123456789abcdef"[i] for i in random.integers(0, 16, random.integers(20, 41))) + '"'],
        lambda: [f"{random.integers(1, 999)}.{number(2)}"], lambda: [f"{random.integers(1900, 2100)}-{random.integers(1, 12):02d}-{random.integers(1, 28):02d}"],
        lambda: [f"({number(random.integers(1, 3))})"], lambda: [f"[{number(1)}]"], lambda: [f"{number(2)}:{number(2)}"], lambda: [f"#{number(6)}"],
        lambda: ["AKIA" + number(3) + name(8, 9).upper()], lambda: [f"({name()}"], lambda: [f"@{name()}"], lambda: [f"{number(3)}-{number(2)}"],
        lambda: [f"{name()}{number(2)}"], lambda: ["(at", name() + ")"], lambda: [f"{number(1)},{number(3)}"], lambda: [f"{number(5)}-{number(6)}"],
    ]
    rows = []
    for at in range(limit):
        # Three rows of five hold personal data; every form takes its turn.
        if at % 5 < 3:
            kind, make = personal[(at // 5 * 3 + at % 5) % len(personal)]
            core = make()
            tags = [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(core))]
        else:
            core = other[(at // 5 * 2 + at % 5 - 3) % len(other)]()
            tags = ["O"] * len(core)
        before, after = fillers(random.integers(0, 3)), fillers(random.integers(0, 3))
        if random.integers(0, 3) == 0:
            core[-1] += ".,;!"[random.integers(0, 4)]
        rows.append(([*before, *core, *after], ["O"] * len(before) + tags + ["O"] * len(after)))
    return rows


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(s) for s in sequences)
    filled = np.zeros((len(sequences), longest, sequences[0].shape[1]), np.int64)
    there = np.zeros((len(sequences), longest), bool)
    for i, s in enumerate(sequences):
        filled[i, :len(s)], there[i, :len(s)] = s, True
    return filled, there


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], epochs: int = EPOCHS, rate: float = 0.3, weight_decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x label) and transitions (label x label) by adaptive gradient steps on the log-likelihood."""
    number = {name: i for i, name in enumerate(LABELS)}
    feats, there = _padded([features(w) for w, _ in rows])
    gold = np.zeros(there.shape, np.int64)
    for i, (_, tags) in enumerate(rows):
        gold[i, :len(tags)] = [number[t] for t in tags]
    count, longest, size = *there.shape, len(LABELS)
    emit, move = np.zeros((DIMENSIONS, size)), np.zeros((size, size))
    seen_emit, seen_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    observed_move = np.zeros_like(move)
    both = there[:, 1:]
    np.add.at(observed_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    observed = np.zeros((count, longest, size))
    observed[np.arange(count)[:, None], np.arange(longest)[None, :], gold] = 1
    for _ in range(epochs):
        score = emit[feats].sum(axis=2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = _logsum(forward[:, t - 1, :, None] + move[None], 1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        whole = _logsum(forward[:, -1], 1)
        chance = np.exp(forward + backward - whole[:, None, None])
        gap = (observed - chance) * there[:, :, None]
        grad = np.zeros_like(emit)
        for k in range(feats.shape[2]):
            np.add.at(grad, feats[:, :, k][there], gap[there])
        pair = forward[:, :-1, :, None] + move[None, None] + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        grad_move = observed_move - (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        grad, grad_move = grad / count - weight_decay * emit, grad_move / count - weight_decay * move
        seen_emit += grad ** 2
        seen_move += grad_move ** 2
        emit += rate * grad / np.sqrt(seen_emit)
        move += rate * grad_move / np.sqrt(seen_move)
    return emit, move


def _scores(feats: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Sum of the weights of all features, one feature at a time."""
    total = emit[feats[..., 0]]
    for k in range(1, feats.shape[-1]):
        total += emit[feats[..., k]]
    return total


def viterbi_long(size: int, words_at: Callable[[int, int], list[str]], emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of one sequence of any length, read and scored in pieces.

    The best scores are carried from piece to piece; one byte a word and label stays for the way back.
    """
    labels = len(LABELS)
    back = np.empty((size, labels), np.int8)
    best = np.zeros(0)
    for lo in range(0, size, PIECE):
        hi = min(lo + PIECE, size)
        first = max(lo - 1, 0)  # a neighbour on each side gives the words at the borders their features
        score = _scores(features(words_at(first, min(hi + 1, size)))[lo - first:hi - first], emit)
        for t in range(lo, hi):
            if t == 0:
                best = score[0]
                continue
            paths = best[:, None] + move
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + score[t - lo]
    path = np.empty(size, np.int8)
    label = int(best.argmax())
    for t in range(size - 1, -1, -1):
        path[t] = label
        label = int(back[t, label]) if t else label
    return path


def viterbi(sequences: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """Best label numbers of each sequence, many sequences at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    first = 0
    while first < len(order):
        # Batches hold a bounded number of padded words.
        longest = len(sequences[order[min(first + BATCH, len(order)) - 1]])
        last = min(first + max(1, min(BATCH, BATCH * 16 // max(longest, 1))), len(order))
        some = order[first:last]
        feats, there = _padded([sequences[i] for i in some])
        score = _scores(feats, emit)
        best, back = score[:, 0], []
        for t in range(1, score.shape[1]):
            paths = best[:, :, None] + move[None]
            step = paths.max(axis=1) + score[:, t]
            stay = np.broadcast_to(np.arange(len(LABELS)), step.shape)
            back.append(np.where(there[:, t, None], paths.argmax(axis=1), stay))
            best = np.where(there[:, t, None], step, best)
        label = best.argmax(axis=1)
        path = [label]
        for pointers in reversed(back):
            label = pointers[np.arange(len(some)), label]
            path.append(label)
        path = np.stack(path[::-1], axis=1)
        for row, i in enumerate(some):
            out[i] = path[row, :len(sequences[i])]
        first = last
    return out


_TRIM_LEFT, _TRIM_RIGHT = "\"'<|,;:!?", "\"'<>|.,;:!?"
_MASKED = re.compile(r"[A-Za-z0-9._%+-]+\s*[(\[{]at[)\]}]\s*[A-Za-z0-9-]+(?:\s*(?:\.|[(\[{]dot[)\]}])\s*[A-Za-z0-9-]+)+", re.I)


def _plausible(kind: str, text: str) -> bool:
    """Exact conditions a labelled span must meet."""
    digits = _digits(text)
    if kind == "email":
        return _MASKED.fullmatch(text) is not None
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[\s().0-9+-]+", text) is not None
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[\s.0-9-]+", text) is not None
    return False  # other spellings of addresses are not added


def _runs(marked: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words within ``REACH`` of a marked word of the same row."""
    at = np.flatnonzero(marked)
    first = end = -1
    for i in at:
        lo = int(i)
        while lo > 0 and i - lo < REACH and rows[lo - 1] == rows[i]:
            lo -= 1
        hi = int(i) + 1
        while hi < len(rows) and hi - i <= REACH and rows[hi] == rows[i]:
            hi += 1
        if first >= 0 and lo <= end and rows[first] == rows[i]:
            end = hi
        else:
            if first >= 0:
                yield first, end
            first, end = lo, hi
    if first >= 0:
        yield first, end


def _together(ranges: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Ranges of at most ``PIECE`` words in batches of bounded size, longer ones alone."""
    held: list[tuple[int, int]] = []
    size = 0
    for a, b in ranges:
        if held and (b - a > PIECE or len(held) == BATCH or size + b - a > BATCH * 4):
            yield held
            held, size = [], 0
        if b - a > PIECE:
            yield [(a, b)]
        else:
            held.append((a, b))
            size += b - a
    if held:
        yield held


def _free_spans(raw: np.ndarray, more: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of ``more`` (byte positions, ascending) that touch none of ``base``, as code points."""
    borders = [b for _, b, _ in base]
    reach = np.maximum.accumulate([f for _, _, f in base]) if base else []
    out, at, chars = [], 0, 0
    for kind, s, e in more:
        # Code points are counted once along the text.
        chars += int(np.count_nonzero((raw[at:s] & 0xC0) != 0x80))
        end = chars + int(np.count_nonzero((raw[s:e] & 0xC0) != 0x80))
        at = s
        before = bisect_left(borders, end)
        if before == 0 or reach[before - 1] <= chars:
            out.append((kind, chars, end))
    return out


def field_spans(data: np.ndarray, offsets: np.ndarray, emit: np.ndarray, move: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Row -> (kind, byte start, byte end) of what the field finds and the conditions confirm."""
    rows, starts, ends, _ = words(data, offsets, NOT_SPACE, None)
    if not len(rows):
        return {}
    signs = np.flatnonzero(_MARKED[data[offsets[0]:offsets[-1]]]) + offsets[0]
    marked = np.searchsorted(signs, ends) > np.searchsorted(signs, starts)
    ranges = list(_runs(marked, rows))
    raw = lambda a, b: data[a:b].tobytes().decode()
    found: dict[int, list[tuple[str, int, int]]] = {}
    texts = lambda a, b: [raw(starts[i], ends[i]) for i in range(a, b)]
    for some in _together(ranges):
        if some[0][1] - some[0][0] > PIECE:
            paths = [viterbi_long(b - a, lambda i, j, a=a: texts(a + i, a + j), emit, move) for a, b in some]
        else:
            paths = viterbi([features(texts(a, b)) for a, b in some], emit, move)
        for (a, b), path in zip(some, paths):
            i = 0
            while i < len(path):
                name = LABELS[path[i]]
                if name[0] != "B":
                    i += 1
                    continue
                j = i + 1
                while j < len(path) and LABELS[path[j]] == f"I-{name[2:]}":
                    j += 1
                s, e = int(starts[a + i]), int(ends[a + j - 1])
                text = raw(s, e)
                left, right = len(text) - len(text.lstrip(_TRIM_LEFT)), len(text) - len(text.rstrip(_TRIM_RIGHT))
                text = text[left:len(text) - right]
                if text and _plausible(name[2:], text):
                    found.setdefault(int(rows[a]), []).append((name[2:], s + left, e - right))
                i = j
    return found



def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end) and spans (base plus the field's) for every row.

    Null and empty texts have no spans; positions are code points, end exclusive; spans of the
    field that touch a base span are left out.  Repeated rows give equal spans.
    """
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(train(labelled_rows()))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, move = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            base_rows, all_rows = [], []
            for lo, hi in row_groups(offsets):
                cut = offsets[lo:hi + 1]
                extra = field_spans(data, cut, emit, move)
                signs = np.flatnonzero(_MARKED[data[cut[0]:cut[-1]]]) + cut[0]
                some = np.searchsorted(signs, cut[1:]) > np.searchsorted(signs, cut[:-1])
                for row in range(hi - lo):
                    if not some[row]:
                        base_rows.append([])
                        all_rows.append([])
                        continue
                    raw = data[cut[row]:cut[row + 1]]
                    base = base_spans(raw.tobytes().decode())
                    more = _free_spans(raw, [(kind, s - cut[row], e - cut[row]) for kind, s, e in extra.get(row, [])], base)
                    base_rows.append(base)
                    all_rows.append(sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0]))))
            as_rows = lambda lists: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in lists], span)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), as_rows(base_rows), as_rows(all_rows)], names=["doc_id", "base", "spans"])

    one = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(find, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, base {one}, spans {one}")


def span_digests(found: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
