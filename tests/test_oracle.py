"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import re

import pytest

from fleetgauge.plans import load_all
from tests.compare import compare, oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], FOLDER) is None


def test_every_operator_group_is_registered():
    wanted = {"S": 18, "P": 29, "J": 25, "A": 54, "W": 18, "T": 3, "U": 6, "F": 20, "X": 8, "Y": 6}
    have = {group: {int(re.match(r"[A-Z](\d+)", n)[1]) for n in QUERIES if n[0] == group} for group in wanted}
    assert {g: sorted(set(range(1, n + 1)) - have[g]) for g, n in wanted.items()} == {g: [] for g in wanted}
