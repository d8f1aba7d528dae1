"""Estimates of sources, languages and all documents against brute force."""

import random

import numpy as np
import pytest

from fleetgauge.llm import quality

SOURCES = [("en", "a", 260), ("en", "b", 240), ("en", "junk", 12), ("de", "c", 40), ("de", "single", 1), ("fr", None, 230)]


def text(rng, junk):
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90))]
    if junk:
        made = [f"#{w.upper()}|$%&<>" for w in made]
    return " ".join(made)


def features(r):
    letters, words = max(r.n_upper + r.n_lower, 1), max(r.n_words, 1)
    return [np.log(max(r.word_chars, 1) / words), np.log1p(r.n_symbols / words), np.sqrt(r.n_dup_lines / max(r.n_lines, 1)),
            np.sqrt(r.n_repeat_words / words), np.sqrt(r.n_upper / letters), np.sqrt(r.n_same_words / words)]


def white_of(spread):
    return np.linalg.inv(np.linalg.cholesky(spread))


def starts(x):
    n, p = x.shape
    floors = np.array(quality.FLOORS)
    bins = np.sort(np.floor(x * 256 + 0.5), axis=0) / 256
    lo, middle, hi = (bins[int(np.ceil(q * n)) - 1] for q in (0.25, 0.5, 0.75))
    scale = np.maximum((hi - lo) / 1.349, floors)
    z = (x - middle) / scale
    norm = np.sqrt(np.square(z).sum(axis=1))
    sign = np.where(norm[:, None] > 0, z / np.where(norm > 0, norm, 1)[:, None], 0)
    yield middle, np.diag(1 / scale)
    for kind, u, weight in ((1, np.tanh(z), np.ones(n)), (2, sign, np.ones(n)), (3, z, 1 / (1 + norm ** 2))):
        mean = np.average(u, axis=0, weights=weight)
        spread = (u * weight[:, None]).T @ u / weight.sum() - np.outer(mean, mean)
        size = np.sqrt(np.maximum(np.diag(spread), 0))
        related = np.eye(p)
        for i in range(p):
            for j in range(p):
                if i != j and size[i] >= 1e-9 and size[j] >= 1e-9:
                    related[i, j] = spread[i, j] / (size[i] * size[j])
        white = white_of(0.9 * related + 0.1 * np.eye(p)) / scale
        yield (middle + mean * scale if kind == 3 else middle), white


def squared(x, centre, white):
    return np.square((x - centre) @ white.T).sum(axis=1)


def concentrated(x, centre, white):
    n, floors = len(x), np.array(quality.FLOORS)
    bins = np.floor(np.log2(squared(x, centre, white) + 2.0 ** -20) * 64)
    ordered = np.sort(bins)
    near = x[np.searchsorted(ordered, bins) < n * quality.COVERAGE]
    reach = quality._chi2_quantile(1 - quality.COVERAGE, len(floors))
    spread = np.cov(near.T, bias=True) * quality.COVERAGE / quality._chi2_cdf(reach, len(floors) + 2) + np.diag(floors ** 2)
    return near.mean(axis=0), spread, np.linalg.slogdet(spread)[1]


def least_determinant(x):
    """(centre, spread, all determinants seen) of one group."""
    tried = []
    for centre, white in starts(x):
        for _ in range(2):
            centre, spread, size = concentrated(x, centre, white)
            white = white_of(spread)
        tried.append((round(size, 6), len(tried), centre, spread, size))
    _, _, centre, spread, size = min(tried, key=lambda t: t[:2])
    seen = [t[4] for t in tried]
    while True:
        after = concentrated(x, centre, white_of(spread))
        if not after[2] < size - quality.TOLERANCE:
            return centre, spread, seen
        centre, spread, size = after
        seen.append(size)


def drawn(levels):
    """Estimate of the last of (rows) from that of all rows down: all, language, source."""
    centre, spread, _ = least_determinant(levels[0])
    for x in levels[1:]:
        own = len(x) / (len(x) + quality.PRIOR_ROWS)
        at, wide, _ = least_determinant(x)
        centre, spread = own * at + (1 - own) * centre, own * wide + (1 - own) * spread
    return centre, white_of(spread)


def score(docs):
    found = {r.doc_id: r for r in quality.score_documents(docs).collect()}
    return found, {i: features(r) for i, r in found.items()}


def check_all(found, x, place):
    """Every distance and verdict against brute force; ``place`` gives language and source."""
    good = [i for i in place if not found[i].base_failed]
    rows = lambda some: np.array([x[i] for i in some])
    for lang, source in {place[i] for i in good}:
        mine = [i for i in good if place[i] == (lang, source)]
        estimate = drawn([rows(good), rows([i for i in good if place[i][0] == lang]), rows(mine)])
        want = squared(rows(mine), *estimate)
        assert np.allclose([found[i].distance for i in mine], want, rtol=1e-6)
        assert [found[i].kept for i in mine] == list(want <= quality.CUTOFF)


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_small_sources_beside_large_ones(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_MODELS", broadcast)
    rng = random.Random(11)
    rows = [(lang, source, text(rng, source in ("junk", "single"))) for lang, source, count in SOURCES for _ in range(count)]
    place = {i: (lang, source) for i, (lang, source, _) in enumerate(rows)}
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(3)
    found, x = score(docs)
    assert len(found) == len(rows) and not any(r.base_failed for r in found.values())
    check_all(found, x, place)
    assert not any(r.kept for i, r in found.items() if place[i][1] in ("junk", "single"))
    assert quality.keep_good(docs).count() == sum(r.kept for r in found.values())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_source_of_the_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found, x = score(docs)
    check_all(found, x, {r.doc_id: (r.lang, r.source) for r in docs.select("doc_id", "lang", "source").collect()})
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in found and not found[r.doc_id].base_failed]
    assert all(found[r.doc_id].kept for r in labels if r.quality == 1)
    bad = [r for r in labels if r.quality == 0]
    assert bad and sum(not found[r.doc_id].kept for r in bad) >= 0.9 * len(bad)


def mixed_rows(outliers):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(300 - outliers, 6)) @ np.array([[1, .9, 0, 0, 0, 0]] + [[0] * i + [1] + [0] * (5 - i) for i in range(1, 6)])
    apart = rng.normal(size=(outliers, 6)) * 0.05 + np.array([3, -3, 2, 0, 0, 0])
    return np.concatenate([clean, apart])


@pytest.mark.parametrize("outliers", [0, 30, 70])
def test_determinants(spark, outliers):
    """The least determinant of all starts is kept, and steps go on until it no longer falls.

    A tenth of rows apart stays outside.  With 70 of 300 in one narrow cluster the least
    determinant itself takes them in: it is below the one reached from the clean rows.
    """
    x = mixed_rows(outliers)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(6)))
    (got,) = quality.least_determinants(rows).collect()
    centre, spread, seen = least_determinant(x)
    assert got.logdet == pytest.approx(min(seen)) and np.allclose(got.centre, centre) and np.allclose(quality._square(got.white), white_of(spread))
    again = concentrated(x, centre, white_of(spread))
    assert again[2] >= got.logdet - quality.TOLERANCE
    clean = x[:len(x) - outliers]
    at, wide, size = concentrated(x, clean.mean(axis=0), white_of(np.cov(clean.T)))
    for _ in range(20):
        at, wide, size = concentrated(x, at, white_of(wide))
    assert got.logdet <= size + 0.05  # a determinant at most five hundredths above
    if outliers == 30:
        assert squared(x[-outliers:], centre, white_of(spread)).min() > quality.CUTOFF


def test_starts_differ_and_none_is_needed_alone():
    x = mixed_rows(70)
    after = [concentrated(x, centre, white)[2] for centre, white in starts(x)]
    assert max(after) - min(after) > quality.TOLERANCE


def test_null_groups_and_no_good_document(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, None, None), (2, long, None, None), (3, "short", "en", "a"), (4, None, None, "b"), (None, long, "en", None)]
    found = quality.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in found) == [(0, True), (1, True), (2, True), (3, False), (4, False)]
    failed = quality.score_documents(spark.createDataFrame(rows[2:4], "doc_id long, text string, lang string, source string")).collect()
    assert [(r.distance, r.kept) for r in failed] == [(None, False)] * 2
