"""Links and representatives of rows whose ids are null or repeated, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from fleetgauge.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    words = [w.lower() for w in WORDS.findall(text or "")]
    return frozenset(tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def classes(texts, percent=85):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                root[find(i)] = find(j)
    return [find(n) for n in range(len(texts))], sets


@pytest.fixture(scope="module")
def rows():
    random_ = random.Random(6)
    base = [" ".join(f"w{random_.randint(0, 400)}" for _ in range(60)) for _ in range(12)]
    texts = []
    for n in range(90):
        words = random_.choice(base).split()
        for _ in range(random_.choice([0, 0, 1, 2, 5])):
            words[random_.randrange(len(words))] = f"x{random_.randint(0, 900)}"
        texts.append(" ".join(words))
    texts += ["", None, " ", "one two", "one two", "three"]
    return [(random_.choice([None, n, n % 7]), t, "x", 1) for n, t in enumerate(texts)] + [(None, "", "y", 2), (None, "one two", "y", 2), (5, "", "y", 1)]


def test_components_of_all_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string, id int").repartition(4)
    found, sets = classes([r[1] for r in rows])
    least = {}
    for root, (doc_id, *_), s in zip(found, rows, sets):
        if doc_id is not None and s:
            least[root] = min(least.get(root, doc_id), doc_id)
    want = Counter((r[0], len(s), least.get(root) if s else r[0]) for root, r, s in zip(found, rows, sets))
    assert Counter(tuple(r) for r in jaccard.jaccard_components(df).collect()) == want


def test_one_row_of_each_component_stays(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string, id int").repartition(4)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    left = Counter(tuple(r) for r in kept.collect())
    found, sets = classes([r[1] for r in rows])
    of_text = {r[1]: root for root, r in zip(found, rows)}
    empty = Counter(r for r, s in zip(rows, sets) if not s)
    assert all(left[r] == n for r, n in empty.items())
    per = defaultdict(list)
    for r, n in left.items():
        if shingles(r[1]):
            per[of_text[r[1]]] += [r] * n
    best = {}
    for root, r, s in zip(found, rows, sets):
        if s:
            best[root] = min(best.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    # Every component has exactly one row left, and it is one with its smallest id.
    assert set(per) == set(best) and all(len(v) == 1 for v in per.values())
    assert {c: (v[0][0] is None, v[0][0] or 0) for c, v in per.items()} == best


def test_unrelated_text_of_a_repeated_id_stays(spark):
    text = " ".join(f"w{n}" for n in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (2, "other words of another kind"), (None, text + " more")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.keep_one(df).collect()} == {(1, text), (2, "other words of another kind")}
    both = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert both[None, 38] == 1
