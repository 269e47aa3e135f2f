import duckdb
import pytest


@pytest.fixture
def frame(spark):
    """DataFrame of documents ``(doc_id, text)`` with an extra column of a clashing name."""

    def make(rows, extra=None):
        schema = "doc_id bigint, text string" + (f", {extra} string" if extra else "")
        return spark.createDataFrame([(*r, *(["x"] if extra else [])) for r in rows], schema)

    return make


@pytest.fixture
def duck():
    return duckdb.connect()
