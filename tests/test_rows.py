"""Null rules, edges and quirks of row-wise code on tiny frames."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hazegrid.functions import calendar as C
from hazegrid.functions import clean
from hazegrid.functions import levels as L
from hazegrid.functions.rounding import half_even
from hazegrid.operators import filters as O
from hazegrid.operators.joins import with_all_bucket


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_flags_keep_nulls(spark):
    df = spark.createDataFrame([(12.0,), (12.0001,), (34.9999,), (35.0,), (None,)], "v double")
    assert values(L.level_flags(df, "v", "v"), "harmful", "not_harmful") == [
        (0.0, 1.0),
        (0.0, 0.0),
        (0.0, 0.0),
        (1.0, 0.0),
        (None, None),
    ]


def test_share_labels(spark):
    rows = [(0.0, 0.0), (0.01, 0.02), (0.02, 0.1), (0.03, 0.9), (0.06, 0.98), (0.14, -1.0), (None, None)]
    out = L.share_categories(spark.createDataFrame(rows, "h double, l double"), "h", "l")
    assert values(out, "harmful_cat", "low_cat") == [
        ("0-1", "0-2"),
        ("", ""),
        ("1-3", "10-90"),
        ("3-6", "90-98"),
        ("6-14", "98+"),
        ("14+", ""),
        ("", ""),
    ]


def test_level_bins_are_right_closed(spark):
    rows = [(x,) for x in (-0.1, 0.0, 6.0, 6.1, 35.0, 35.1, 1000.0, 1001.0, None)]
    df = spark.createDataFrame(rows, "v double")
    got = [r[0] for r in df.select(L.level_bins(F.col("v"))).collect()]
    assert got == [None, "0-6", "0-6", "6-12", "22-35", "35+", "35+", None, None]


def test_half_hours_and_calendar(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp_ntz'2020-07-04 18:29:59.5', timestamp_ntz'2020-07-04 18:30:00',"
        " timestamp_ntz'2020-07-04 18:44:59', NULL)) AS t"
    )
    got = [r[0] for r in df.select(C.floor_half_hour(F.col("t"))).collect()]
    assert got == [
        dt.datetime(2020, 7, 4, 18, 0),
        dt.datetime(2020, 7, 4, 18, 30),
        dt.datetime(2020, 7, 4, 18, 30),
        None,
    ]
    row = C.calendar_features(df, "t").first()
    assert (row["Hourly"], row["Monthly"], row["Yearly"]) == (18, 7, 2020)
    assert row["MonthYear"] == dt.date(2020, 7, 1)
    assert C.calendar_features(df, "t", hourly=False, monthly=False).columns == ["t", "Daily", "Yearly"]


def test_text_clean_up(spark):
    df = spark.createDataFrame(
        [("(41.5, -87.25)", "2020-01-01", None, 7, None, None), ("(1,2)", "2020-01-01", "10:00", 8, 7.0, "inside")],
        "loc string, d string, t string, ID bigint, ParentID double, device_loc string",
    )
    lat, lon = clean.parse_point(F.col("loc"))
    assert values(df, lat, lon) == [(41.5, -87.25), (1.0, 2.0)]
    assert values(df, C.join_date_and_time(F.col("d"), F.col("t"))) == [(None,), ("2020-01-01 10:00",)]
    out = clean.fill_parent(df, "ID", "ParentID", "device_loc")
    assert values(out, "ID", "ParentID", "device_loc") == [("7", "7", "missing"), ("8", "7", "inside")]
    code = spark.createDataFrame([("170315301001004.0",), ("170315301001004",)], "c string")
    assert {r[0] for r in code.select(clean.canonical_code(F.col("c"))).collect()} == {"170315301001004"}


def test_casts(spark):
    df = spark.createDataFrame([(1.9, "x"), (None, "y")], "a double, b string")
    out = clean.cast_present(df, ["a", "b", "absent"], "string")
    assert out.dtypes == [("a", "string"), ("b", "string")] and out.collect()[1]["a"] is None
    assert clean.cast_present(df.where("a IS NOT NULL"), ["a"], "bigint", required=True).first()["a"] == 1
    with pytest.raises(PySparkException):
        clean.cast_present(df, ["a"], "bigint", required=True).collect()
    with pytest.raises(PySparkException):
        clean.cast_present(df, ["b"], "double").collect()


def test_filters_join_all_conditions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1)], "k string, n int")
    assert O.category_filter(df, {"k": ["a"], "n": [1]}).count() == 1
    assert O.range_filter(df, {"n": [1, 5]}).count() == 2
    with pytest.raises(ValueError):
        O.category_filter(df, {"missing": [1]})


def test_box_ignores_zero_and_missing(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (None, 1.0), (2.0, 2.0)], "x double, y double")
    assert O.bbox_filter(df, "x", "y", -1.0, -1.0, 2.0, 2.0).count() == 2


def test_date_cutoff_edges(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2020-01-02 00:00:00', timestamp_ntz'2020-01-02 00:00:01')) AS t")
    assert O.date_cutoff(df, "t", "2020-01-02").count() == 1
    assert O.date_cutoff(df, "t", "2020-01-02", inclusive=False).count() == 0


def test_zscore(spark):
    rows = [(float(i % 2), 1.0) for i in range(100)] + [(1000.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert O.zscore_filter(df, ["a"]).count() == 100
    assert O.zscore_filter(df, ["b"]).count() == 0  # constant: no z-score
    report = O.zscore_report(df, ["a"]).first()
    assert (report["n_rows"], report["n_all_null"], report["n_kept"], report["n_outliers"]) == (102, 1, 100, 1)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.675,), (-0.25,), (None,)], "v double")
    assert [r[0] for r in df.select(half_even(F.col("v"), 0)).collect()] == [0.0, 2.0, 3.0, -0.0, None]
    assert df.select(half_even(F.col("v"), 1)).collect()[3][0] == -0.2


def test_all_bucket_is_distinct(spark):
    df = spark.createDataFrame([(1, "x", 2020), (1, "x", 2021), (1, "x", 2021)], "id int, v string, y int")
    got = set(values(with_all_bucket(df, ["y"]), "id", "v", "y"))
    assert got == {(1, "x", "2020"), (1, "x", "2021"), (1, "x", "All")}
    assert with_all_bucket(df, ["y"]).count() == 3


def test_season_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderdate")
    plan = O.season_filter(orders, "o_orderdate", after_year=1997)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan
    one = O.season_filter(orders, "o_orderdate", after_year=1990, year=1999)
    years = {r[0] for r in one.select(F.year("o_orderdate")).distinct().collect()}
    assert years == {1999}
