"""Token output: pieces of words against the library, the coder's parts, what tasks of a worker share."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetgauge.llm import rangecoder, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_of_words_have_the_ids_of_the_library(library):
    random_ = np.random.default_rng(5)
    parts = ["a", "Zé", "é", "×", "÷", "ÿ", "ſ", "é", "日本", "ª", "²", "½", "'", "'s", "'re", "'T", "’", ".", ",", "$$$", "###", "7", "42", "_", "-",
             "\x00", "\x7f", "…", "the", "word", "Ã", "\u0303", " ", " ", "\n"]
    texts = ["".join(parts[n] for n in random_.integers(0, len(parts), random_.integers(1, 14))) for _ in range(4000)]
    ours = tokens.Tokenizer(PATH)
    assert [x.tolist() for x in ours.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ours.ids(texts[::-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts[::-1]]


def test_a_word_is_learnt_once_whatever_stands_after_it(library, monkeypatch):
    asked = []
    whole = tokens.Tokenizer._whole
    ours = tokens.Tokenizer(PATH)
    monkeypatch.setattr(tokens.Tokenizer, "_whole", lambda self, texts: asked.extend(texts) or whole(self, texts))
    text = "go lantern, a lantern. the lantern### or lantern's lantern"
    assert ours.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert "".join(asked).count(" lantern") == 1


def test_places_of_keys_that_meet():
    places = tokens._Places()
    keys = (np.arange(1, 1001, dtype=np.uint64) << np.uint64(20)) | np.uint64(7)  # low bits all the same, then many more
    for at in range(0, 60, 20):
        assert (places.find(keys[at:at + 20]) == -1).all()
        places.add(keys[at:at + 20])
    spread = np.random.default_rng(3).permutation(np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    places.add(spread)
    assert (places.find(keys[:60]) == np.arange(60)).all()
    assert (places.find(spread) == 60 + np.arange(200_000)).all()
    assert (places.find(keys[60:1000]) == -1).all()


def test_the_coder_in_several_parts():
    random_ = np.random.default_rng(7)
    for ids in (random_.integers(0, 500, 10_000), np.minimum(random_.zipf(1.3, 9_999), 1 << 31), np.arange(70_000) * 60_000, np.zeros(1_025, np.int64)):
        for part in (4096, 1 << 21):
            assert (rangecoder.decode(rangecoder.encode(ids, 64, part)) == ids).all()
    assert (rangecoder.decode(rangecoder.encode(np.arange(300), 64, 1)) == np.arange(300)).all()


def test_first_occurrences_in_a_block_cost_no_escapes():
    ids = np.random.default_rng(9).integers(30_000, 30_256, 1 << 18)
    # A flat choice of 256 ids is one byte each; an escape and 16 bits per first occurrence in a block took 1.23.
    assert len(rangecoder.encode(ids)) < 1.1 * len(ids)


def test_tasks_of_a_worker_share_the_tokenizer(spark, library):
    texts = ["one lantern", "two lanterns, one light"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    rows = tokens.read_documents(tokens.encode_documents(docs, PATH)).orderBy("doc_id").collect()
    sizes = [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert [r.n_tokens for r in rows] == sizes and [r.start for r in rows] == (np.cumsum(sizes) - sizes).tolist()

    def seen(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            kept = getattr(sys.modules.get("fleetgauge_worker"), "tokenizers", {})
            yield pa.RecordBatch.from_arrays([pa.array([t.known.count for t in kept.values()], pa.int64())], names=["n"])

    found = spark.range(64, numPartitions=16).mapInArrow(seen, "n long").agg(F.max("n")).first()[0]
    assert found and found >= 3
