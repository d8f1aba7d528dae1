"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import chat, decontamination, html, jaccard, mixing, pii, quality, rangecoder, sharding, tokens, urls, words
from fleetgauge.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, shard string, _n long, id long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(300_000))
    texts = [None, "", " \n\t ", "one", "one", "A b c d e f", "a b c d e f", long, "é" * 40 + " ü", "#### $$ || <>", None, "one"]
    rows = [(None if i in (3, 10) else i if i != 11 else 4, t, None if i % 3 else "en", None if i % 4 else "s", 1, "h", "s", 1, 1, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra string")


def test_decontamination(spark, odd):
    items = benchmark(spark, [(1, "A, b! c d e f", "x"), (2, None, "x"), (3, "", None), (None, "one", None), (1, "a b c d e f", "x")])
    for block in (50_000, 3):
        rows = decontamination.find_hits(odd, items, out="found", block_words=block).collect()
        assert len(rows) == 12
        assert {(r.text, tuple(r.found["items"])) for r in rows if r.found["items"]} == {("A b c d e f", ("1",)), ("a b c d e f", ("1",))}
        assert all(r.found.spans == [[0, 1]] for r in rows if r.text == "one")
    left = decontamination.decontaminate(odd, items)
    assert left.columns == odd.columns
    assert left.filter("text IN ('one', 'a b c d e f')").count() == 0 and left.filter("text IS NULL").count() == 2
    assert decontamination.decontaminate(odd, items.limit(0)).count() == 12
    assert decontamination.decontaminate(odd.limit(0), items).count() == 0


def test_automaton_equals_brute_force():
    random.seed(4)
    for trial in range(60):
        size = random.choice([3, 4])
        items = [[random.choice(b"abc").to_bytes() for _ in range(random.randint(0, 9))] for _ in range(random.randint(1, 5))]
        text = [random.choice(b"abcd").to_bytes() for _ in range(80)]
        automaton = decontamination.SuffixAutomaton(items, size)
        spans, bits, longest = automaton.spans(text)
        hit, found = set(), set()
        for n, item in enumerate(items):
            k = min(size, len(item))
            for j in range(len(item) - k + 1 if k else 0):
                for i in range(len(text) - k + 1):
                    if text[i:i + k] == item[j:j + k]:
                        hit |= set(range(i, i + k))
                        found.add(n)
        assert {w for a, b in spans for w in range(a, b)} == hit
        assert {n for n in range(len(items)) if bits >> n & 1} == found
        assert longest == max((k for it in items for j in range(len(it)) for k in range(1, len(it) - j + 1)
                               if any(text[i:i + k] == it[j:j + k] for i in range(len(text) - k + 1))), default=0)


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, "x y z. One two three four! tail " + "pad " * 200)], "doc_id long, text string")
    items = benchmark(spark, [(1, "one TWO three four", "")])
    text = decontamination.decontaminate(docs, items, window=3, span_words=4).first().text
    assert text.startswith("x y z. ! tail pad")


def test_sharding(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 12 and all(r.text_crc32 == 0 and r["size"] == 8 for r in rows if r.doc_id in (0, 1))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd.limit(0)).count() == 0
    assert sharding.least_loaded([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_slots_over_several_parts(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("s"), (F.col("id") % 10).alias("k"))
    got = sharding.number_slots(rows, "s", ["k"], slot_rows=50).groupBy("s").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in got.collect())


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://WWW.Example.com/en/a?x", "v"), (2, "http://sub.example.com/en/", "v"), (3, "http://example.com", "v"), (4, None, "v"), (5, "no scheme", "v"),
        (6, "http://a.net/es/x", "v"), (6, "http://a.net/es/x", "v"), (7, "http://", "v"), (8, "http://notexample.com/en/", "v"), (9, "x://com/", "v"), (10, "", "v"),
        (11, "http://b.net\nx/fr/#y", "v")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
                                   ("net", "/es/", "allow"), (None, "/", "block")], "host string, path string, action string")
    rows = sorted(tuple(r) for r in urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    assert rows == [
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "sub.example.com", "/en/", "example.com/en/", "block"),
        (3, "example.com", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "a.net", "/es/x", "net/es/", "block"),
        (6, "a.net", "/es/x", "net/es/", "block"), (7, "", "", None, "allow"), (8, "notexample.com", "/en/", "com/", "allow"), (9, "com", "/", "com/", "allow"),
        (10, "", "", None, "allow"), (11, "b.net\nx", "/fr/", None, "allow")]
    assert urls.judge_urls(pages, rules.limit(0)).filter("rule IS NOT NULL").count() == 0
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def components(rows, size=4, percent=85):
    """Brute force over all pairs."""
    sets = {}
    for key, text in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
        ws = [w for w in ws if w]
        sets[key] = {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())
    low = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {k: (len(sets[k]), low[k]) for k in sets}


def test_jaccard_families(spark, monkeypatch):
    """A large family of edited copies, chains, shared passages and short texts, with small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    random.seed(7)
    word = lambda: random.choice(["the", "of", "and"]) if random.random() < 0.3 else f"w{random.randint(0, 4000)}"
    base = [word() for _ in range(90)]
    rows = []
    for _ in range(120):
        copy = list(base)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for _ in range(25):
        chain = list(chain)
        chain[random.randrange(60)] = word()
        rows.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    rows += [" ".join(passage + [word() for _ in range(random.choice([2, 4, 30]))]) for _ in range(60)]
    rows += ["a b", "A  B", "a b c", "", None, "x y z q r s t", "x y z q r s", "   "]
    rows += [" ".join(word() for _ in range(random.randint(1, 200))) for _ in range(60)]
    table = [(i, t) for i, t in enumerate(rows)]
    want = components(table)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_jaccard_edges(spark, odd):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == 12
    assert {(r.n_shingles, r.component_id) for r in rows if r.n_shingles == 0} >= {(0, 0), (0, 1), (0, 2)}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert sorted(r.component_id for r in rows if r.n_shingles == 1 and r.doc_id != 8) [:3] == [4, 4, 4]
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("text = 'one' AND doc_id = 4").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd):
    rows = mixing.mix_rows(odd).collect()
    assert len(rows) == 12 and all(0 <= r.copies <= 3 for r in rows)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_documents(odd).count() == sum(r.copies for r in rows)
    assert mixing.mix_rows(odd.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r.target, r.taken) for r in mixing.mix_rows(empty).collect()} == {(0, 0.0, 0)}


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left = 2100 - 30 - 270
    assert got["a"] == 30 and got["d"] == 0 and got[None] == 270
    assert got["b"] == pytest.approx(left * 2 / 3) and got["c"] == pytest.approx(left / 3)


def test_chat(spark):
    rows = [(1, 1, "user", "a<b\\l"), (1, 2, "user", None), (1, 0, None, "x"), (1, 3, "assistant", "</turn>\n<part>"), (1, 3, "assistant", ""),
            (2, 0, "a>b", "\\s"), (None, 0, "assistant", "é\\"), (1, 2, "user", None)]
    turns = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(turns)
    back = {r.conv_id: [tuple(t) for t in r.t] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("", "x"), ("user", "a<b\\l"), ("user", ""), ("user", ""), ("assistant", ""), ("assistant", "</turn>\n<part>")],
                    2: [("a>b", "\\s")], None: [("assistant", "é\\")]}
    loss = {r.conv_id: r.s for r in chats.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("s")).collect()}
    assert loss == {1: "</turn>\n<part>", 2: "", None: "é\\"}
    assert chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0


def test_range_coder_round_trips():
    random_ = np.random.default_rng(2)
    for count in (0, 1, 2, 15, 17, 300, 5000):
        for ids in (random_.integers(0, 65536, count), np.minimum(random_.zipf(1.2, count), 65535), np.full(count, 7)):
            assert (rangecoder.decode(rangecoder.encode(ids, 256)) == ids).all()
    # Long stretches of sure guesses, then surprises.
    ids = np.concatenate([np.tile(np.arange(40), 400), random_.integers(0, 65536, 2000), np.tile(np.arange(3), 3000)])
    for size in (64, 4096, 1 << 15):
        assert (rangecoder.decode(rangecoder.encode(ids, size)) == ids).all()
    # Ids of 16 bits and more, in segments of one short block and of several.
    for count in (1, 5, 700):
        ids = random_.integers(0, 1 << 32, count)
        assert (rangecoder.decode(rangecoder.encode(ids, 64)) == ids).all()
        ids = np.where(random_.random(count) < 0.5, 65_536 + np.arange(count) % 3, np.arange(count) % 7)
        assert (rangecoder.decode(rangecoder.encode(ids, 64)) == ids).all()
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([1 << 32]))


def test_no_damage_goes_unseen():
    data = rangecoder.encode(np.arange(700) % 50, 256)
    for at in range(len(data)):
        for flip in (1, 128, 255):
            bad = bytearray(data)
            bad[at] ^= flip
            with pytest.raises(ValueError):
                rangecoder.decode(bytes(bad))
    for size in range(len(data)):
        with pytest.raises(ValueError):
            rangecoder.decode(data[:size])
    with pytest.raises(ValueError):
        rangecoder.decode(data + b"x")


def test_tokens(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), tokens.Tokenizer(path)
    texts = ["", " ", "a  b", " lead", "trail ", "a \n b", "x y", "it's o'clock's  12 3", "a\nb c", "<|endoftext|> a", "don't ' s 's",
             "tab\t x", "x\t", "\n", "é ü\u3000 z", "a\x85b c", "日本 語", "a\r\n b", "1 2,3 4"]
    assert [x.tolist() for x in ours.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    segments = tokens.encode_documents(odd, path, segment_ids=1000)
    rows = tokens.read_documents(segments).orderBy("start").collect()
    assert len(rows) == 12 and [r.doc_id for r in rows] == sorted([r.doc_id for r in odd.collect()], key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert tokens.read_documents(tokens.encode_documents(odd.limit(0), path)).count() == 0


def test_pii(spark, odd):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == 12 and all(not r.base and not r.spans for r in rows if r.doc_id not in (7,))
    assert pii.find_personal_data(odd.limit(0)).count() == 0


def test_pii_patterns_on_odd_strings():
    from tests.llm.test_queries import plain_spans

    random.seed(3)
    alphabet = "a1@..-+ ()9 b%_é"
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
        assert [f"{k}:{s}:{e}" for k, s, e in pii.base_spans(text)] == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@") == []


def test_field_on_held_out_rows():
    emit, move = pii.train(pii.labelled_rows())
    held = pii.labelled_rows(300, seed=77)
    paths = pii.viterbi([pii.features(w) for w, _ in held], emit, move)
    assert sum([pii.LABELS[i] for i in p] == t for p, (_, t) in zip(paths, held)) >= 0.97 * len(held)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<nav>a</nav><footer>b</footer>", ""), ("plain words only", "plain words only"),
    ("<html><body><div id='main'><h1>T &amp; U</h1><p>one  two\nthree<br>four</p><p>x</div><aside>no</aside><footer>f</footer>", "T & U\none two three four\nx"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>body text of the article</p><form>f</form><div class='reader-comments'><p>hi</p></div></article>", "T\nbody text of the article"),
    ("<p>cut off mid <b>wor", "cut off mid wor"), ("<article><p>a</p></article>", "a"),
    ("<div class='ad'>x</div><article><p>a <span class='sponsor'>s</span> b</p></article>", "a\nb")])
def test_main_text(page, text):
    assert html.main_text(page or "") == text


def test_pages_pass_through(spark):
    pages = spark.createDataFrame([(1, "<p>abc", "old"), (1, "<p>abc", "old"), (2, None, None)], "page_id long, html string, text string")
    rows = html.extract_main_text(pages).collect()
    assert sorted((r.page_id, r.text) for r in rows) == [(1, "abc"), (1, "abc"), (2, "")]
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_quality(spark, odd):
    rows = quality.score_documents(odd).collect()
    assert len(rows) == 12 and not any(r.kept for r in rows if r.n_words < 20)
    assert [r.kept for r in rows if r.doc_id == 7] == [True]
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 1
    assert quality.score_documents(odd.limit(0)).count() == 0


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    random.seed(5)
    texts = ["".join(random.choice("ab \n\tÉc") for _ in range(random.randint(0, 400))) for _ in range(30)] + ["x" * 300]
    data, offsets = words.utf8(pa.array(texts))
    rows, starts, ends, hashes = words.words(data, offsets)
    got = [(r, data[s:e].tobytes().decode()) for r, s, e in zip(rows, starts, ends)]
    assert got == [(n, w) for n, t in enumerate(texts) for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
    assert len(set(hashes)) == len({w for _, w in got})


def test_any_column_name_passes_through(spark):
    """Columns named like the helpers of operators and stages."""
    text = " ".join(f"w{n}" for n in range(60))
    names = ["hits", "_hits", "_mix_source", "_mix_whole", "_source", "_whole", "_prefix", "_copy", "_lost", "_again", "_own", "_gone_id", "_shared_id", "_gone", "hash", "size", "id", "component"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, f"{text} {'x' * i}", "en", "s", 1, *names) for i in (1, 2, 2, 3)] + [(None, None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (lambda d: decontamination.decontaminate(d, benchmark(spark, [(1, "nothing of it", "")])), mixing.mix_documents, jaccard.keep_one):
        out = stage(docs)
        assert out.columns == docs.columns and all(r[5:] == tuple(names) for r in map(tuple, out.collect()))
    with pytest.raises(ValueError, match="hits"):
        decontamination.find_hits(docs, benchmark(spark, [(1, "a", "")]))


@pytest.mark.parametrize("share, words_", [(0.05, 2), (0.3, 12), (0.4, 16), (1.0, 40)])
def test_shares_are_exact(spark, share, words_):
    text = lambda n: " ".join([f"b{i}" for i in range(n)] + [f"w{i}" for i in range(40 - n)])
    docs = spark.createDataFrame([(n, text(n)) for n in range(2, 41)], "doc_id long, text string")
    items = benchmark(spark, [(1, " ".join(f"b{i}" for i in range(40)), "")])
    left = decontamination.decontaminate(docs, items, window=2, share=share)
    assert {r.doc_id for r in left.collect()} == set(range(2, words_))


def test_many_sources_are_joined(spark, monkeypatch):
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 40}") for i in range(400)] + [(1000, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sent = sorted(map(tuple, mixing.mix_rows(docs).collect()))
    monkeypatch.setattr(mixing, "SENT_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix_rows(docs).collect())) == sent
