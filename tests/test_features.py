"""Feature preparation rules."""

import pytest
from pyspark.errors import PySparkException

from hazegrid.operators import features as M
from hazegrid.operators import profiling as S


def column(df, name):
    return [r[name] for r in df.collect()]


def test_standardize_and_rescale_constants(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    train, test = M.standardize(df, df, ["c", "x"])
    assert column(train, "Norm c") == [0.0, 0.0] and column(test, "Norm x") == [-1.0, 1.0]
    train, none = M.minmax_rescale(df, None, ["c", "x"])
    assert column(train, "Rescaled c") == [None, None] and none is None
    assert column(train, "Rescaled x") == [0.0, 1.0]


def test_impute_uses_train_mean(spark):
    train = spark.createDataFrame([(1.0, True, None), (3.0, None, "a")], "n double, b boolean, t string")
    test = spark.createDataFrame([(None, False, None)], "n double, b boolean, t string")
    _, out = M.impute(train, test, ["b"], None, ["n"], None, ["t"], "none")
    assert out.first().asDict() == {"n": 2.0, "b": 0, "t": "none"}
    filled, _ = M.impute(train, None, bools=["b"], bool_fill=0, numbers=["n"], number_fill=9.0)
    assert column(filled, "b") == [1, 0]


def test_one_hot_aligns_test(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    test = spark.createDataFrame([("c",), ("a",)], "t string")
    a, b = M.one_hot(train, test, ["t"], ["p"])
    assert a.columns == b.columns == ["p_a", "p_b"]
    assert [tuple(r) for r in b.collect()] == [(0, 0), (1, 0)]
    assert tuple(a.collect()[2]) == (0, 0)


def test_encoder_refuses_unknown(spark):
    train = spark.createDataFrame([("a",), ("b",)], "t string")
    encoder = M.OneHotEncoder(["t"]).fit(train)
    assert encoder.transform(train).columns == ["t_<a>", "t_<b>"]
    with pytest.raises(PySparkException):
        encoder.transform(spark.createDataFrame([("z",)], "t string")).collect()
    with pytest.raises(ValueError):
        M.OneHotEncoder(["t"]).transform(train)


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    out, test = M.quantile_bins(df, df, "x", 4)
    assert column(out, "Discrete x") == [0, 0, 1, 1, 2, 2, 3, 3] == column(test, "Discrete x")
    same = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "x double")
    with pytest.raises(PySparkException):
        M.quantile_bins(same, None, "x", 4)[0].collect()


def test_width_bins_closed_side(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    right, _ = M.width_bins(df, None, "x", 2)
    left, _ = M.width_bins(df, None, "x", 2, right=False)
    assert column(right, "Discrete x") == [0, 0, 1, None]
    assert column(left, "Discrete x") == [0, 1, 1, None]


def test_split_is_repeatable_and_whole(spark):
    df = spark.range(10_000)
    train, test = M.random_split(df, 0.2, 4, ["id"])
    again, _ = M.random_split(df.repartition(7), 0.2, 4, ["id"])
    assert train.count() + test.count() == 10_000 and 1700 < test.count() < 2300
    assert set(column(train, "id")) == set(column(again, "id"))
    assert set(column(M.random_split(df, 0.2, 5, ["id"])[1], "id")) != set(column(test, "id"))


def test_equal_rows_are_drawn_apart(spark):
    """Without a key, rows that are equal do not all land on one side."""
    same = spark.range(2_000).selectExpr("1 AS x")
    train, test = M.random_split(same, 0.25, 3)
    assert train.count() + test.count() == 2_000 and 400 < test.count() < 600


def test_one_hot_map(spark):
    train = spark.createDataFrame([("a", 1), ("b", None), (None, 2)], "t string, n int")
    test = spark.createDataFrame([("c", 1), ("a", 7)], "t string, n int")
    a, b = M.one_hot_map(train, test, ["t", "n"], ["p", "n"])
    assert [set(r["encoded"]) for r in a.collect()] == [{"p_a", "n_1"}, {"p_b"}, {"n_2"}]
    assert sorted(tuple(r["encoded"]) for r in b.collect()) == [("n_1",), ("p_a",)]


def test_profile_of_gaps(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (2, None, None)], "n int, t string, e double")
    got = {r["column"]: r for r in S.table_profile(df).collect()}
    assert (got["n"]["unique_values"], got["n"]["example"]) == (2, "2")
    assert (got["t"]["unique_values"], got["t"]["na_values"], got["t"]["example"]) == (3, 1, "a")
    assert (got["e"]["percent_na"], got["e"]["example"]) == (1.0, None)
    assert [r["column"] for r in S.table_profile(df).collect()][0] == "t"


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    row = S.histogram(df, "x", bins=10).first()
    assert row["count"] == 3 and row["density"] == pytest.approx(10.0)
