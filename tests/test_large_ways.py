"""The way for large lookups, forced on, against the same oracles."""

import os

import pytest

from hazegrid.catalog import load_all
from hazegrid.operators import joins
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
NAMES = (
    "top_decile_flag",
    "outdoor_only_filter",
    "left_join_suffixes",
    "geotag_layers",
    "polygon_intersects_join",
    "within_radius_join",
    "histogram_by_category",
)


@pytest.mark.parametrize("name", NAMES)
def test_large_way(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "fits_in_memory", lambda *a, **k: False)
    queries, oracles = load_all()
    df = queries[name](spark, SF_DIR)
    assert "rightHint=(strategy=broadcast)" not in df._jdf.queryExecution().toString()
    assert compare(df, connect(SF_DIR), oracles[name]) == []
