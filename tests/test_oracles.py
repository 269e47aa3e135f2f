"""Every registered query against its SQL oracle (rows only where SQL has none)."""

import os

import pytest

from hazegrid import session
from hazegrid.catalog import load_all
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = load_all()
# Nested loops compare every row with every other; Python nodes leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name, monkeypatch):
    """The result, and the plans of it and of everything staged on the way."""
    monkeypatch.setattr(session, "STAGED_PLANS", plans := [])
    df = QUERIES[name](spark, SF_DIR)
    plans.append(df._jdf.queryExecution().toString())
    assert not [n for n in UNWANTED for plan in plans if n in plan]
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "AQ_mean" in df.columns and "EPA_harmful" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
