"""Tokeniser alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest

from fleetgauge.llm import queries
from fleetgauge.llm.alignment import Aligner, align, align_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "x", "  two  spaces ", "\n\nlines\n\n\nmore \n x", "tab\there", "nul\0 here x", "▁ bar x", "café 你好 \U0001F600\U0001F601 x",
    "<|endoftext|> <s> a</s>", "don't  can't x", " lead", "trail ", "\x1c\x1d a", "a b c", "x́ é", "a" * 3000, "�﻿ z",
    "<0x0A> <unk>", "x\r\ny z\x85w", "12345 6789,10", " \nfoo", "\nfoo bar", "a \n b", "a\n"]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


def plain(aligner, text):
    if not text:
        return (0, 0, 0, 0), "", Counter()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return (0, 0, 0, 0), "", Counter()
    ends = [list(accumulate(map(len, parts))) for parts in (a_bytes, b_bytes)]
    places = [{end: n + 1 for n, end in enumerate(e)} for e in ends]
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        m, n = places[0][end], places[1][end]
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        links[a[m - 1], b[n - 1]] += 1
        i, j = m, n
    return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def expected(aligner, texts):
    found = [plain(aligner, t) for t in texts]
    total, best = sum((f[2] for f in found), Counter()), Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(*f[0], sum(n for p, n in f[2].items() if total[p] == best[p[1]]), sum(n * total[p] for p, n in f[2].items()), f[1]) for f in found]


def test_align():
    assert align([1, 3, 5], [2, 3, 5]) == ([3, 5], [2, 3], [2, 3])
    assert align([], []) == ([], [], [])


def test_pieces_equal_whole_texts(aligner):
    random_ = random.Random(3)
    texts = ODD + ["".join(random_.choices(["a", "Z", " ", " ", "\n", "é", "\t", "1", "'s", "▁", "<s>", "　", "..."], k=random_.randint(1, 40))) for _ in range(400)]
    for text, (counts, digest, pairs, times) in zip(texts, aligner.rows(texts)):
        want = plain(aligner, text)
        assert (counts, digest, {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times)}) == (want[0], want[1], dict(want[2]))


@pytest.mark.parametrize("head", [1_000_000, 7, 0])
def test_odd_rows(spark, aligner, head):
    texts = ODD + ["x", "one two", "one two", " ".join(f"w{i % 977} x{i % 50}" for i in range(60_000))]
    ids = [None if n in (3, 4) else n // 2 for n in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in zip(ids, texts)], "doc_id long, text string, n_a int, row string, code int").repartition(3)
    got = align_documents(docs, A, B, head_pairs=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *w) for i, w in zip(ids, expected(aligner, texts)))
    assert align_documents(docs.limit(0), A, B).count() == 0


def test_query_against_plain_version(spark, aligner):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], expected(aligner, [d.text for d in docs])))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_tokenizer_alignment(spark, folder).collect()}
    assert got == want
