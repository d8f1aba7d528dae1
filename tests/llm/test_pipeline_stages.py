"""Every stage of the pipeline against brute force on its own input, and on odd tables."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from fleetgauge.llm import quality
from tests.llm.test_shared_estimates import check_all, score

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)])


def representatives(rows):
    """Smallest id of each component of linked rows, and all rows without words."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i for i in ids if root(i) == i}


def hit_share(text, windows):
    words = ITEM_WORD.findall((text or "").translate(LOWER))
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
    return len(hit), len(words)


def targets(total):
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(total))}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * w / share for s, w in weight.items()}
        over = {s for s in weight if s not in capped and target[s] > 3 * total[s]}
        if not over:
            return target
        capped |= over


def check_mix(before, after):
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    source = {r.doc_id: r.source for r in before}
    total, taken, largest = Counter(), Counter(), Counter()
    for i, s in source.items():
        total[s] += size[i]
        largest[s] = max(largest[s], size[i])
    copies = Counter(r.doc_id for r in after)
    assert set(after) <= set(before) and max(copies.values()) <= 3
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets(total).items())


def check_shards(before, after):
    text = {r.doc_id: r.text for r in before}
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    place, load, slots, group = {}, Counter(), defaultdict(list), Counter()
    for r in after:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert place.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r["size"]
        group[raw] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Longest processing time: the shard that a group raised was the least loaded one before.
    assert max(load.values()) <= sum(load.values()) / 24 + max(group.values())


def test_stages_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs = [docs.collect()]
    for number, stage in enumerate(stages.values()):
        docs = stage(spark, docs, FOLDER)
        inputs.append(docs.collect())
        docs = spark.createDataFrame(inputs[-1], docs.schema)
    found, x = score(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    check_all(found, x, {r.doc_id: (r.lang, r.source) for r in inputs[0]})
    assert sorted(inputs[1]) == sorted(r for r in inputs[0] if found[r.doc_id].kept)
    best = representatives(inputs[1])
    assert sorted(inputs[2]) == sorted(r for r in inputs[1] if r.doc_id in best) and len(inputs[2]) < len(inputs[1])
    windows = set()
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = ITEM_WORD.findall((item.text or "").translate(LOWER))
        windows |= {tuple(words[i:i + 13]) for i in range(max(len(words) - 12, 1))} if words else set()
    dirty = {r.doc_id for r in inputs[2] for hit, n in [hit_share(r.text, windows)] if hit and 20 * hit >= n}
    assert sorted(inputs[3]) == sorted(r for r in inputs[2] if r.doc_id not in dirty)
    check_mix(inputs[3], inputs[4])
    check_shards(inputs[4], inputs[5])


@pytest.fixture
def odd_folder(spark, tmp_path):
    plain = lambda n: " ".join(f"word{n}x{i}" for i in range(40))
    names = ["hits", "grp", "shard", "component", "k", "x0", "distance"]
    rows = [(1, plain(1), "en", "a"), (2, plain(1), "en", "a"), (2, plain(2), "en", None), (None, plain(3), None, "a"), (None, plain(3), None, "a"),
            (5, None, "en", "a"), (6, "", "en", "a"), (7, " ".join(plain(i) for i in range(10, 3_000)), "en", "a"), (8, plain(4), "en", "a"), (8, plain(4), "en", "a")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(*r, *names) for r in rows], schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for folder in ("full", "empty"):
        items = [(1, None), (2, ""), (None, plain(2))] if folder == "full" else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    return str(tmp_path)


def test_odd_tables(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/full/documents.parquet")
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id or 0 for r in good.collect()) == [0, 0, 1, 2, 2, 7, 8, 8]
    single = corpus_pipeline.near_duplicate_stage(spark, good, odd_folder)
    # Text 1 under its smallest id, text 2 beside it, one of the rows without an id, one of the equal rows.
    assert sorted(((r.doc_id or 0), r.text.split(" ")[0]) for r in single.collect()) == [
        (0, "word3x0"), (1, "word1x0"), (2, "word2x0"), (7, "word10x0"), (8, "word4x0")]
    clean = corpus_pipeline.decontamination_stage(spark, single, f"{odd_folder}/full")
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 7, 8]
    placed = corpus_pipeline.run(spark, f"{odd_folder}/full").collect()
    assert {r.doc_id for r in placed} <= {None, 1, 7, 8} and placed


def test_empty_tables(spark, odd_folder):
    rows = corpus_pipeline.run(spark, f"{odd_folder}/empty")
    assert rows.count() == 0 and {"doc_id", "shard", "slot"} <= set(rows.columns)
