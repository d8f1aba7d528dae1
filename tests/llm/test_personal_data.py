"""The field on rows written by hand, on long sequences, and in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from fleetgauge.llm import pii
from fleetgauge.llm.words import utf8

import pyarrow as pa

# Text and the personal data in it, by kind; none is from the rule that writes the labelled table.
ROWS = {
    "email": [
        ("Please write to jane.doe@example.org before noon.", "jane.doe@example.org"), ("Mail (bob_smith+news@mail.example.co.uk) or call.", "bob_smith+news@mail.example.co.uk"),
        ("Contact: support@a-b.net", "support@a-b.net"), ("reach me at maria (at) example.com for details", "maria (at) example.com"),
        ("my address is peter [at] example [dot] org thanks", "peter [at] example [dot] org"), ("info(at)example.de is read daily", "info(at)example.de"),
        ("send it to lena[at]example[dot]com please", "lena[at]example[dot]com"), ("<x1@y2.fr>, second", "x1@y2.fr"), ("Ask karl (at) example.net.", "karl (at) example.net"),
        ("E-mail:sales@shop.example", "sales@shop.example")],
    "ip": [
        ("Host 10.0.0.1 is down", "10.0.0.1"), ("from 192.168.100.254, port 80", "192.168.100.254"), ("http://8.8.8.8/x", "8.8.8.8"), ("127.0.0.1:8080", "127.0.0.1"),
        ("ping 001.002.003.004 now", "001.002.003.004"), ("(172.16.254.3)", "172.16.254.3"), ("ip=1.1.1.1;", "1.1.1.1"), ("255.255.255.0 mask", "255.255.255.0")],
    "card": [
        ("Paid with 4111111111111111 today", "4111111111111111"), ("card 4111 1111 1111 1111 was used", "4111 1111 1111 1111"), ("5500-0000-0000-0004 expired", "5500-0000-0000-0004"),
        ("No. 340000000000009.", "340000000000009"), ("use 6011 0000 0000 0004, please", "6011 0000 0000 0004"), ("visa:4012888888881881", "4012888888881881"),
        ("30000000000004 is old", "30000000000004"), ("the number 3088-0000-0000-0009 again", "3088-0000-0000-0009")],
    "phone": [
        ("Call +49 30 1234567 now", "+49 30 1234567"), ("tel. +1 (555) 010-9999.", "+1 (555) 010-9999"), ("phone (555) 123-4567 for help", "(555) 123-4567"),
        ("ring 212-555-0187 today", "212-555-0187"), ("fax: (212)555-0188", "(212)555-0188"), ("mobile +33.6.12.34.56.78", "+33.6.12.34.56.78"),
        ("dial (020) 794 6095 from here", "(020) 794 6095"), ("our office: (415) 555-2671, ask for Ann", "(415) 555-2671"), ("or 800-555-0199 toll free", "800-555-0199"),
        ("+442079460958", "+442079460958")],
}
CLEAN = [
    "Version 3.11.2 came out on 2023-04-05 at 10:30.", "It cost 1,299.00 or 12 % more than 1,159.82.", "See chapter 4.2.1 and figure 17 (b).", "Order #448812 of 3 items, ref AB-2291.",
    "The years 1914-1918 and 1939-1945.", "a[0] = b[12] + c(3)", "Meet @ noon (at the gate) please", "ISBN no, pages 200-345, vol. 12", "sha 0f1e2d3c4b5a", "Rooms 101, 102 and 103 @home"]


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_rows())


def spans_of(text: str, model) -> list[tuple[str, str]]:
    data, offsets = utf8(pa.array([text]))
    raw = np.frombuffer(text.encode(), np.uint8)
    base = pii.base_spans(text)
    more = pii._free_spans(raw, pii.field_spans(data, offsets, *model).get(0, []), base)
    return [(k, text[s:e]) for k, s, e in [*base, *more]]


@pytest.mark.parametrize("kind", ROWS)
def test_recall_on_hand_written_rows(model, kind):
    found = sum((kind, want) in spans_of(text, model) for text, want in ROWS[kind])
    assert found >= 0.9 * len(ROWS[kind]), [(t, spans_of(t, model)) for t, w in ROWS[kind] if (kind, w) not in spans_of(t, model)]


def test_clean_rows_stay_clean(model):
    assert [(t, spans_of(t, model)) for t in CLEAN if spans_of(t, model)] == []


def test_long_sequences_decode_as_short_ones(model, monkeypatch):
    random = np.random.default_rng(5)
    some = [w for row in pii.labelled_rows(200, seed=3) for w in row[0]]
    for size in (1, 2, 7, 8, 9, 200, 401):
        words = [some[i] for i in random.integers(0, len(some), size)]
        want = pii.viterbi([pii.features(words)], *model)[0]
        for piece in (1, 8, 200):
            monkeypatch.setattr(pii, "PIECE", piece)
            assert (pii.viterbi_long(size, lambda a, b, w=words: w[a:b], *model) == want).all()


def test_memory_of_long_numeric_texts(model):
    text = " ".join(str(n) for n in range(100_000, 160_000)) + " call (555) 123-4567 now"
    data, offsets = utf8(pa.array([text]))
    tracemalloc.start()
    found = pii.field_spans(data, offsets, *model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("phone", "(555) 123-4567") in [(k, text[s:e]) for k, s, e in found[0]]
    assert peak < 20 * len(text) + 20_000_000, peak  # some 60 bytes a word and one piece; 340 bytes a character when all scores were held


def test_spans_beside_base_spans():
    raw = np.frombuffer("éé ab cd ef".encode(), np.uint8)
    assert pii._free_spans(raw, [("phone", 5, 7), ("phone", 8, 10)], [("ip", 6, 8)]) == [("phone", 3, 5)]
    assert pii._free_spans(raw, [("phone", 5, 7)], []) == [("phone", 3, 5)]
    assert pii._free_spans(raw, [("phone", 5, 7), ("card", 11, 13)], [("email", 0, 4)]) == [("card", 9, 11)]
