"""Operators on whole texts send them to the Python workers in batches of bounded size."""

import pyarrow as pa
import pytest

from fleetgauge.llm import decontamination, jaccard, quality
from fleetgauge.llm.storage import BATCH_BYTES, BATCH_LIMIT

TEXT = " ".join(f"word{n}" for n in range(600))


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})


def documents(session, rows):
    return session.createDataFrame([(i, f"{i} {TEXT}", "en", "web") for i in range(rows)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("operator", [
    lambda s, d: quality.text_counts(d, "text", ["doc_id"]), lambda s, d: jaccard.jaccard_components(d),
    lambda s, d: decontamination.decontaminate(d, s.createDataFrame([("a", "x y")], "item_id string, text string"))],
    ids=["quality", "jaccard", "decontamination"])
def test_texts_travel_in_small_batches(spark, operator):
    session = spark.newSession()
    docs = documents(session, 2000).coalesce(1)
    assert operator(session, docs).count() == 2000
    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 4 * BATCH_BYTES
    assert max(found) < 1.25 * BATCH_BYTES


def test_a_limit_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(BATCH_LIMIT, "1m")
    quality.text_counts(documents(session, 3), "text", ["doc_id"])
    assert session.conf.get(BATCH_LIMIT) == "1m"
