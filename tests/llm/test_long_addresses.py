"""Address parts longer than Python turns into an integer."""

from fleetgauge.llm import pii


def test_parts_of_many_zeros():
    zeros = "0" * 5000
    assert ("ip", 0, 5006) in pii.base_spans(f"{zeros}.1.2.3")
    assert not [s for s in pii.base_spans(f"{zeros}256.1.2.3") if s[0] == "ip"]
    assert not [s for s in pii.base_spans("9" * 5000 + ".1.2.3") if s[0] == "ip"]
