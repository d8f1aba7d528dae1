"""Quality rules and robust multivariate outliers.

Counts per document come from one vectorised pass over whole texts.  Six of their ratios form a
vector per document; per language and source, per language and over all documents the
minimum-covariance-determinant estimate of its centre and spread is found by concentration steps
from several starts, each one aggregation over all documents.  Estimates of sources are drawn
towards those of languages and of all, and documents with a large Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.storage import saved, small_batches
from fleetgauge.llm.words import EXACT_VALUES, NOT_SPACE, PIECE_BYTES, mix64, row_groups, utf8, windows, words

WINDOW_WORDS = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
PRIOR_ROWS = 200      # rows that the estimate of the level above counts for
COVERAGE = 0.75       # share of rows in a concentration step
TOLERANCE = 1e-3      # fall of the logarithm of the determinant that ends the steps
MOST_STEPS = 30
RIDGE = 0.1           # part of the identity in the correlations of a start
TAIL = 1e-3           # chance of a larger distance under normality
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "loops")
# Smallest spread that counts, in units of the transformed features: below it ratios say nothing.
FLOORS = (0.25, 0.06, 0.30, 0.30, 0.10, 0.10)
SIZE = len(FEATURES)
BROADCAST_MODELS = 10_000
PARTS = 16            # tasks among which rows of one estimate are dealt where models are not broadcast

_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_CHARS = np.array([NOT_SPACE[b] and not 0x80 <= b <= 0xBF for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.uint8)
_LOWER = np.array([97 <= b <= 122 for b in range(256)], np.uint8)
_LINE = np.array([b != 10 for b in range(256)])


def _row_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of ``table[byte]`` per row, in pieces of bounded size."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a in range(int(offsets[0]), int(offsets[-1]), PIECE_BYTES):
        b = min(a + PIECE_BYTES, int(offsets[-1]))
        total = np.concatenate([[0], np.cumsum(table[data[a:b]], dtype=np.int64)])
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        edge = np.clip(offsets[lo:hi + 1], a, b) - a
        out[lo:hi] += np.diff(total[edge])
    return out


def _repeated_words(rows: np.ndarray, hashes: np.ndarray, count: int, size: int) -> np.ndarray:
    """Words per row that lie in a window of ``size`` words found twice or more in the row."""
    n = len(rows) - size + 1
    if n <= 0:
        return np.zeros(count, np.int64)
    inside = np.flatnonzero(rows[:n] == rows[size - 1:])
    at, value = windows(rows, hashes, size)
    key = value ^ mix64(at.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(count, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = inside[twice[place] == key]
    edge = np.bincount(starts, minlength=len(rows) + size + 1)[:len(rows) + size + 1].astype(np.int64)
    edge[size:] -= edge[:-size].copy()
    covered = np.cumsum(edge)[:len(rows)] > 0
    return np.bincount(rows[covered], minlength=count)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) per row."""
    rows, starts, ends, hashes = words(data, offsets, _LINE, EXACT_VALUES)
    _, first, _, _ = words(data, offsets, NOT_SPACE, None)
    with_word = np.searchsorted(first, ends) > np.searchsorted(first, starts)
    # A word that began in an earlier line cannot reach into this one: line ends are white space.
    rows, key = rows[with_word], (hashes ^ mix64(rows.astype(np.uint64) + np.uint64(1)))[with_word]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(rows, minlength=count), np.bincount(rows[again], minlength=count)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_same_words")


def count_rows(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    count = len(offsets) - 1
    rows, _, _, hashes = words(data, offsets, NOT_SPACE, EXACT_VALUES)
    same = rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])]
    lines, dup = _duplicate_lines(data, offsets, count)
    sums = lambda table: _row_sums(data, offsets, table)
    return dict(zip(COUNTS, (
        np.bincount(rows, minlength=count), sums(_CHARS), sums(_SYMBOLS), lines, dup,
        _repeated_words(rows, hashes, count, WINDOW_WORDS), sums(_UPPER), sums(_LOWER),
        np.bincount(same, minlength=count))))


def text_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of every text; a null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for lo, hi in row_groups(offsets):
                found = count_rows(data, offsets[lo:hi + 1])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in keep], *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=[*keep, *COUNTS])

    small_batches(docs.sparkSession)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(count, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _features() -> list[Column]:
    """Transformed ratios, all small and bounded below: logarithms of lengths and rates, roots of shares."""
    words_, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return [
        F.log(chars / words_), F.log1p(F.col("n_symbols") / words_), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words_), F.sqrt(F.col("n_upper") / letters), F.sqrt(F.col("n_same_words") / words_)]


def _chi2_cdf(x: float, p: int) -> float:
    """Distribution function of chi-squared with an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _chi2_quantile(chance_above: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        above = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(p // 2))
        lo, hi = (mid, hi) if above > chance_above else (lo, mid)
    return hi


CUTOFF = _chi2_quantile(TAIL, SIZE)


def _with_model(rows: DataFrame, models: DataFrame, key: str, how: str) -> DataFrame:
    if models.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS:
        return rows.join(F.broadcast(models), key, how)
    # The estimate of a language or of all has far more rows than that of a source.
    dealt = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    copies = models.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("part", F.col("part").cast("long"))
    return dealt.join(copies, [key, "part"], how).drop("part")


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` and the whitening matrix ``white`` (lower triangle by rows)."""
    total, at = F.lit(0.0), 0
    for i in range(SIZE):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.element_at("white", at + 1) * (F.col(f"x{j}") - F.element_at("centre", j + 1))
            at += 1
        total = total + y * y
    return total


MOMENTS = ["k", *[f"s{i}" for i in range(SIZE)], *[f"s{i}_{j}" for i in range(SIZE) for j in range(i + 1)]]


def _moments(weight: Column, x: list[Column]) -> list[Column]:
    sums = [weight, *[weight * v for v in x], *[weight * x[i] * x[j] for i in range(SIZE) for j in range(i + 1)]]
    return [F.sum(v).alias(name) for v, name in zip(sums, MOMENTS)]


def _mean_and_spread(row: dict) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([row[f"s{i}"] for i in range(SIZE)]) / row["k"]
    spread = np.zeros((SIZE, SIZE))
    for i in range(SIZE):
        for j in range(i + 1):
            spread[i, j] = spread[j, i] = row[f"s{i}_{j}"] / row["k"] - mean[i] * mean[j]
    return mean, spread


def _lower(matrix: np.ndarray) -> list[float]:
    return matrix[np.tril_indices(SIZE)].tolist()


def _square(lower: list[float]) -> np.ndarray:
    matrix = np.zeros((SIZE, SIZE))
    matrix[np.tril_indices(SIZE)] = lower
    return matrix


def _scales(rows: DataFrame) -> DataFrame:
    """Median ``m`` and inverse scale ``w`` (from the middle half) of each coordinate, from histograms of 1/256."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f"x{i}") * 256).cast("long").alias("b")) for i in range(SIZE)]))
    counts = rows.select("grp", bins.alias("e")).groupBy("grp", "e.i", "e.b").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("grp", "i").orderBy("b")
    share = F.sum("k").over(upto) / F.sum("k").over(Window.partitionBy("grp", "i"))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("b"))) / 256.0
    spots = counts.withColumn("share", share).groupBy("grp", "i").agg(at(0.5).alias("m"), at(0.25).alias("lo"), at(0.75).alias("hi"))
    floors = F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("i") + 1)
    wide = spots.select("grp", "i", "m", (1 / F.greatest((F.col("hi") - F.col("lo")) / 1.349, floors)).alias("w"))
    packed = wide.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "m", "w"))).alias("v"))  # one entry per feature
    return packed.select("grp", F.transform("v", lambda v: v["m"]).alias("m"), F.transform("v", lambda v: v["w"]).alias("w"))


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, centre, white): the starts of every estimate.

    0: coordinates scaled one by one; 1: correlations of their hyperbolic tangents; 2: of their
    spatial signs; 3: of rows weighted by 1 / (1 + squared norm), with the weighted centre.
    """
    scales = saved(_scales(rows), "scales")
    z = [(F.col(f"x{i}") - F.element_at("m", i + 1)) * F.element_at("w", i + 1) for i in range(SIZE)]
    scaled = _with_model(rows, scales, "grp", "inner").select("grp", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(SIZE)]
    norm = sum((v * v for v in z[1:]), z[0] * z[0])
    kinds = [
        (1, F.lit(1.0), [F.tanh(v) for v in z]), (2, F.lit(1.0), [F.when(norm > 0, v / F.sqrt(norm)).otherwise(0.0) for v in z]), (3, 1 / (1 + norm), z)]
    kinds = F.array(*[F.struct(F.lit(n).alias("start"), weight.alias("v"), *[x.alias(f"u{i}") for i, x in enumerate(u)]) for n, weight, u in kinds])
    shaped = scaled.select("grp", F.explode(kinds).alias("e")).select("grp", "e.*")
    sums = shaped.groupBy("grp", "start").agg(*_moments(F.col("v"), [F.col(f"u{i}") for i in range(SIZE)]))

    def shape(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                median, inverse = np.array(row["m"]), np.array(row["w"])
                mean, spread = _mean_and_spread(row)
                size = np.sqrt(np.maximum(np.diag(spread), 0))
                flat = size < 1e-9
                spread = spread / np.outer(np.where(flat, 1, size), np.where(flat, 1, size))
                spread[flat, :] = spread[:, flat] = 0
                np.fill_diagonal(spread, 1)
                white = np.linalg.inv(np.linalg.cholesky((1 - RIDGE) * spread + RIDGE * np.eye(SIZE))) * inverse
                centre = median + mean / inverse if row["start"] == 3 else median
                out.append((row["grp"], row["start"], centre.tolist(), _lower(white)))
                if row["start"] == 1:
                    out.append((row["grp"], 0, median.tolist(), _lower(np.diag(inverse))))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "white"])

    return sums.join(scales, "grp").mapInPandas(shape, "grp string, start int, centre array<double>, white array<double>")


def _step(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step of every (grp, start), all in one pass over the rows.

    Centre and spread of the ``COVERAGE`` share of rows nearest to the last estimate, and ``logdet``,
    the logarithm of the determinant of that spread with ``FLOORS`` added.  The border is a distance
    bin of 1/64 octave, taken whole, so ties need no order.
    """
    placed = _with_model(rows, models, "grp", "inner").withColumn("bin", F.floor(F.log2(_distance() + 2.0 ** -20) * 64).cast("long"))
    binned = placed.groupBy("grp", "start", "bin").agg(*_moments(F.lit(1.0), [F.col(f"x{i}") for i in range(SIZE)]))
    group = Window.partitionBy("grp", "start")
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0.0))).withColumn("all", F.sum("k").over(group))
    sums = binned.filter(F.col("before") < F.col("all") * COVERAGE).groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    # Spread of the middle part of a normal distribution, brought back to that of the whole.
    factor = COVERAGE / _chi2_cdf(_chi2_quantile(1 - COVERAGE, SIZE), SIZE + 2)

    def estimate(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                mean, spread = _mean_and_spread(row)
                root = np.linalg.cholesky(spread * factor + np.diag(np.square(FLOORS)))
                out.append((row["grp"], row["start"], mean.tolist(), _lower(np.linalg.inv(root)), 2 * float(np.log(np.diag(root)).sum())))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "white", "logdet"])

    return sums.mapInPandas(estimate, "grp string, start int, centre array<double>, white array<double>, logdet double")


def least_determinants(rows: DataFrame) -> DataFrame:
    """(grp, start, centre, white, logdet) with the least determinant found for every ``grp`` of rows (grp, x0, x1, ...).

    All starts take two concentration steps, the one with the least determinant goes on until its
    determinant falls by no more than ``TOLERANCE`` (``MOST_STEPS`` steps at most).  ``rows`` is read
    once per step.
    """
    tried = saved(_step(rows, saved(_step(rows, saved(_starts(rows), "starts")), "mcd")), "mcd")
    # Starts that end in the same estimate differ by rounding only.
    place = F.struct(F.round("logdet", 6), "start")
    best = tried.groupBy("grp").agg(F.min_by(F.struct("start", "centre", "white", "logdet"), place).alias("b"))
    best = saved(best.select("grp", "b.*", F.lit(True).alias("open")), "best")
    for _ in range(MOST_STEPS):
        after = _step(rows, best.filter("open").select("grp", "start", "centre", "white"))
        after = after.select("grp", *[F.col(c).alias(f"next_{c}") for c in ("centre", "white", "logdet")])
        fell = F.coalesce(F.col("next_logdet") < F.col("logdet") - TOLERANCE, F.lit(False))
        best = saved(best.join(after, "grp", "left").select(
            "grp", "start", *[F.when(fell, F.col(f"next_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "white", "logdet")], fell.alias("open")), "best")
        if best.filter("open").isEmpty():
            break
    return best.drop("open")


def _label(*columns: str) -> Column:
    """One text for the values of the columns, whatever their names."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"})


def fit(counted: DataFrame) -> DataFrame:
    """(g2, centre, white) of every language and source (``g1``, ``g2``) with a good document.

    ``counted`` has the columns of ``text_counts``, base_failed, g1 and g2; it is read several
    times.  Estimates are made from all good documents of every source, of every language and of
    the whole input.  Each level is drawn towards the one above by the weight of ``PRIOR_ROWS``
    rows: a source of k rows counts k / (k + PRIOR_ROWS), its language the rest, at every size.
    """
    good = counted.filter(~F.col("base_failed"))
    levels = F.explode(F.array("g2", "g1", F.lit("all")))
    rows = good.select(levels.alias("grp"), *[x.alias(f"x{i}") for i, x in enumerate(_features())])
    best = least_determinants(rows)
    sizes = good.groupBy("g1", "g2").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("k1", F.sum("k").over(Window.partitionBy("g1")))
    level = lambda n, key: best.select(F.col("grp").alias(key), F.col("centre").alias(f"centre{n}"), F.col("white").alias(f"white{n}"))
    known = sizes.join(level(2, "g2"), "g2").join(level(1, "g1"), "g1").drop("g1")
    whole = best.filter("grp = 'all'").select("centre", "white").first()  # none without good documents, and then no row below

    def estimate(centre, white) -> tuple[np.ndarray, np.ndarray]:
        root = np.linalg.inv(_square(white))
        return np.array(centre), root @ root.T

    def draw(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                at, wide = estimate(*whole)
                for n, count in ((1, row["k1"]), (2, row["k"])):
                    own = count / (count + PRIOR_ROWS)
                    centre, spread = estimate(row[f"centre{n}"], row[f"white{n}"])
                    at, wide = own * centre + (1 - own) * at, own * spread + (1 - own) * wide
                out.append((row["g2"], at.tolist(), _lower(np.linalg.inv(np.linalg.cholesky(wide)))))
            yield pd.DataFrame(out, columns=["g2", "centre", "white"])

    return saved(known.mapInPandas(draw, "g2 string, centre array<double>, white array<double>"), "models")


def judge(counted: DataFrame, models: DataFrame) -> DataFrame:
    """Add distance (null where a language and source has no good document) and kept."""
    rows = counted.withColumns({f"x{i}": x for i, x in enumerate(_features())})
    rows = _with_model(rows, models, "g2", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return rows.withColumn("kept", kept).drop("g1", "g2", "centre", "white", *[f"x{i}" for i in range(SIZE)])


def _counted(docs: DataFrame, keep: list[str], text: str, lang: str, source: str) -> DataFrame:
    """``keep`` columns under the names c0, c1, ..., the counts, base_failed, g1 and g2."""
    needed = list(dict.fromkeys([*keep, text, lang, source]))
    name = {c: f"c{n}" for n, c in enumerate(needed)}
    plain = docs.select(*[docs[c].alias(name[c]) for c in needed])
    held = [name[c] for c in needed if c in keep or c in (lang, source)]
    counted = text_counts(plain, name[text], held).withColumn("base_failed", base_failed())
    return counted.withColumns({"g1": _label(name[lang]), "g2": _label(name[lang], name[source])}).drop(
        *[name[c] for c in (lang, source) if c not in keep])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept for every row.

    ``kept`` is false for documents that fail the base rules (null, empty and short texts do) and
    for those whose squared distance exceeds ``CUTOFF``.  Estimates are made from documents that
    pass the base rules, per language and source (null is a value of its own), and drawn towards
    those of the language and of all documents, the more the fewer rows there are.  Rows with equal
    texts in one group get one verdict; repeated rows stay; an empty table gives no rows.
    """
    counted = saved(_counted(docs, [doc_id], text, lang, source), "counts")
    judged = judge(counted, fit(counted))
    return judged.select(F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``docs`` that ``score_documents`` keeps, with all their columns.

    Texts are counted once for the estimates and once more as they pass the verdict, which needs
    no shuffle and no row key.
    """
    found = fit(saved(_counted(docs, [], text, lang, source), "counts"))
    judged = judge(_counted(docs, docs.columns, text, lang, source), found)
    return judged.filter("kept").select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)])
