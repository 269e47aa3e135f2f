"""Aggregates: null rules, both ways of grouped statistics, shares, row numbers."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import aggregates as A
from hazegrid.operators.deciles import top_decile_flag
from hazegrid.operators.quantiles import grouped_stats, number_rows


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_null_rules(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), (None, 5.0), ("b", 7.0), ("c", None)], "k string, v double"
    )
    got = keyed(A.summary_values(df, ["k"], "v"), "k")
    assert set(got) == {("a",), ("b",), ("c",)}
    assert (got[("a",)]["sum"], got[("a",)]["count"], got[("a",)]["mean"]) == (1.0, 2, 1.0)
    nothing = got[("c",)]
    assert (nothing["sum"], nothing["count"]) == (0.0, 1)
    assert nothing["median"] is None and nothing["mean"] is None and nothing["max"] is None


def test_modes_exclude_each_other(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], "k string, v double, count int")
    with pytest.raises(ValueError):
        A.summarize(df, [], ["k"])
    with pytest.raises(ValueError):
        A.summarize(df, [], ["k"], ["v", "count"], [], "v")
    with pytest.raises(ValueError):
        A.summarize(df, [], ["missing"], value="v")


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    row = grouped_stats(df, [], "v", stats=("count",), quantiles={"q": 0.9}).first()
    assert row["q"] == pytest.approx(7.9) and row["count"] == 4


def test_groups_of_every_size(spark):
    """Large, small, flat and empty groups in one pass, against Spark's own aggregates."""
    rng = random.Random(5)
    rows = [("hot", round(rng.gauss(20, 5), 2)) for _ in range(6000)]
    rows += [("flat", 3.0)] * 500 + [("hot", None)] * 20 + [(None, 1.0)] * 5
    rows += [(f"k{i}", round(rng.expovariate(0.1), 3)) for i in range(40) for _ in range(i)]
    rows += [("empty", None)] * 30
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    cuts = {"median": 0.5, "q": 0.9, "low": 0.0, "top": 1.0}
    stats = ("mean", "max", "min", "sum", "count")
    carry = {"w": ("sum", F.lit(2)), "last": ("max", F.concat(F.lit("x"), F.col("v").cast("string")))}
    made = keyed(grouped_stats(df, ["k"], "v", stats, cuts, carry), "k")
    plain = df.where("k IS NOT NULL").groupBy("k").agg(
        F.expr("percentile(v, array(0.5, 0.9, 0, 1))").alias("q"),
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("count"),
        F.sum(F.lit(2)).alias("w"), F.max(F.concat(F.lit("x"), F.col("v").cast("string"))).alias("last"),
    )
    want = keyed(plain, "k")
    assert made.keys() == want.keys()
    for k, row in want.items():
        row = {**row, **dict(zip(cuts, row["q"] or [None] * 4))}
        for name in [*cuts, *stats, *carry]:
            if isinstance(row[name], float):
                assert made[k][name] == pytest.approx(row[name], abs=1e-9), (k, name)
            else:
                assert made[k][name] == row[name], (k, name)


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", inf), ("b", -inf), ("b", 5.0)], "k string, v double")
    got = keyed(grouped_stats(df, ["k"], "v", (), {"top": 1.0, "mid": 0.5, "low": 0.0}), "k")
    a, b = got[("a",)], got[("b",)]
    assert (a["top"], a["mid"], a["low"]) == (inf, 2.0, 1.0) and (b["top"], b["mid"], b["low"]) == (5.0, -inf, -inf)


def test_planning_starts_no_job(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "double(id) AS v")
    spark.sparkContext.setJobGroup("planning", "planning")
    grouped_stats(df, ["k"], "v")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_without_keys_or_order_are_numbered(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", None), ("a", 7), (None, None)], "k string, n int")
    got = sorted((r.k or "", r.id) for r in number_rows(df, ["k"], "n", "id").collect())
    assert got == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1)]


def test_global_statistics(spark):
    rng = random.Random(9)
    values = [rng.uniform(-1, 1) for _ in range(5001)] + [100.0] * 4000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    row = grouped_stats(df, [], "v", ("count", "min"), {"m": 0.5, "q": 0.1}).first()
    assert row["m"] == pytest.approx(statistics.median(values)) and row["count"] == 9001
    empty = grouped_stats(df.where("v > 1000"), [], "v", ("count", "sum"), {"m": 0.5}).collect()
    assert len(empty) == 1 and empty[0]["m"] is None


def test_row_numbers(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 5003) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n bigint").repartition(8)
    got = keyed(number_rows(df, ["k"], "n", "id"), "k", "n")
    for k in "ab":
        order = sorted(n for kk, n in rows if kk == k)
        assert [got[(k, n)]["id"] for n in order] == list(range(len(order)))


def test_shares(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0, 3), ("a", 0.0, 1.0, 1), ("a", None, None, 9), ("b", None, 1.0, 2), ("c", 0.5, 0.5, 4)],
        "k string, harmful double, not_harmful double, count int",
    )
    got = keyed(A.harmful_share(df, ["k"], weight="count"), "k")
    assert (got[("a",)]["harmful"], got[("a",)]["not_harmful"]) == (0.75, 0.25)
    assert got[("b",)]["harmful"] is None  # nothing fully flagged
    assert got[("c",)]["harmful"] == 0.0  # a share that is not one does not count
    weighted = keyed(A.weighted_share(df, ["k"], "harmful", "s"), "k")
    assert weighted[("a",)]["s"] == 0.75 and weighted[("c",)]["s"] == 0.5


def test_rollup_of_rollup(spark):
    rows = [(d, s, float(d * s % 13), 1.0, float(s)) for d in range(5) for s in range(20)]
    df = spark.createDataFrame(rows, "d int, s int, sum double, count double, max double")
    step = A.summary_rollup(df, ["d", "s"], ["sum", "count"], ["max"])
    twice = keyed(A.summary_rollup(step, ["d"], ["sum", "count"], ["max"]), "d")
    assert twice == keyed(A.summary_rollup(df, ["d"], ["sum", "count"], ["max"]), "d")


def test_cell_shares_ignore_rows_without_cell(spark):
    df = spark.createDataFrame(
        [(1, 10, 80.0, 2, 45.0, 1.0, 0.0), (1, 11, 5.0, 1, 5.0, 0.0, 1.0), (1, None, 100.0, 1, 100.0, 1.0, 0.0)],
        "d int, cell int, sum double, count int, max double, harmful double, not_harmful double",
    )
    row = A.rollup_with_cell_shares(df, ["d"], "cell").first()
    assert (row["hex_ct"], row["harmful_hex"], row["not_harmful_hex"]) == (2, 0.5, 0.5)
    assert (row["sum"], row["count"], row["max"], row["harmful"]) == (185.0, 4, 100.0, 0.75)


def test_deciles_cover_all(spark):
    df = spark.createDataFrame([(p, float(i)) for p in (1, 2) for i in range(11)], "p int, mean double")
    got = top_decile_flag(df, ["p"]).groupBy("cat").count().collect()
    assert {r["cat"]: r["count"] for r in got} == {"Top 10%": 4, "Low 90%": 18}


def test_rates_accept_unknown_outcomes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "g string, o string")
    got = keyed(A.group_rates(df, ["g"], "o"), "g")
    assert got[("a",)]["x"] == pytest.approx(1 / 3) and got[("b",)]["y"] == 0.0


def test_small_groups_take_few_shuffles(spark, monkeypatch):
    """Groups on both sides of the size that is sorted, and the shuffles that many small groups take."""
    from hazegrid.operators import quantiles as Q

    monkeypatch.setattr(Q, "SMALL", 40)
    rng = random.Random(11)
    rows = [(k, rng.choice([-0.0, 0.0, 1.5, float(k), rng.gauss(0, 9)])) for k in range(60) for _ in range(k)]
    rows += [(3, None), (3, float("inf")), (100, None), (101, -5.0)] + [(55, None)] * 3
    df = spark.createDataFrame(rows, "k int, v double").withColumn("w", F.col("v") * 2)
    stats, asked = ("mean", "max", "min", "sum", "count"), {"median": 0.5, "low": 0.1, "high": 0.99}
    carry = {"top": ("max", F.col("w")), "all": ("sum", F.lit(1))}
    got = keyed(grouped_stats(df, ["k"], "v", stats, asked, carry), "k")
    want = keyed(
        df.groupBy("k").agg(
            F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"),
            F.count(F.lit(1)).alias("count"), *[F.expr(f"percentile(v, {p}D)").alias(n) for n, p in asked.items()],
            F.max("w").alias("top"), F.count(F.lit(1)).alias("all"),
        ),
        "k",
    )
    assert set(got) == set(want)
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (value if value is None else pytest.approx(value)), (key, name)

    monkeypatch.setattr(Q, "SMALL", 20_000)
    df = grouped_stats(spark.range(9000).selectExpr("id % 3000 AS k", "double(id) AS v"), ["k"], "v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-shuffles", "")
    df.write.format("noop").mode("overwrite").save()
    jobs = len(tracker.getJobIdsForGroup("few-shuffles"))
    spark.sparkContext.setJobGroup("other", "")
    # Adding up all bins of all groups took 13 jobs and more.
    assert jobs <= 8
