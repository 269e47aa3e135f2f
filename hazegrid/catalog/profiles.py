"""Profiles, statistics and chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.operators import profiling as S
from hazegrid.operators.filters import zscore_filter


def _profile_rows(columns: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{kind}' AS type,
                   (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source})) AS unique_values,
                   count(*) FILTER (WHERE {c} IS NULL) AS na_values,
                   round_even((count(*) FILTER (WHERE {c} IS NULL))::DOUBLE / count(*), 2) AS percent_na,
                   (SELECT {c}::VARCHAR FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
                    ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS example
            FROM {source}"""
        for c, kind in columns
    )


@register(
    "table_profile",
    with_tables(
        "flagged",
        _profile_rows(
            [
                ("source", "Object"),
                ("big", "bool"),
                ("sensor_id", "Numeric"),
                ("pm", "Numeric"),
                ("harmful_flag", "Numeric"),
                ("day", "DateTime"),
            ],
            "shown",
        ),
        shown="""SELECT source, value > 100 AS big, sensor_id, pm, harmful::INTEGER AS harmful_flag,
                        "Daily" AS day FROM flagged""",
    ),
)
def table_profile(spark, d):
    shown = D.flagged(spark, d).select(
        F.col("Daily").alias("day"),
        "source",
        "sensor_id",
        (F.col("value") > 100).alias("big"),
        "pm",
        F.col("harmful").cast("int").alias("harmful_flag"),
    )
    return S.table_profile(shown)


@register(
    "numeric_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
                   min({c})::DOUBLE AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
                   quantile_cont({c}, 0.75) AS q3, max({c})::DOUBLE AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    {"mean": 6, "std": 6, "q1": 6, "median": 6, "q3": 6},
)
def numeric_describe(spark, d):
    return S.numeric_describe(
        D.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    )


@register(
    "single_grain_report",
    with_tables(
        "flagged",
        " UNION ALL ".join(
            f"""SELECT category, '{g}' AS grain, count(*) AS observations,
                       max("{g}")::VARCHAR AS only_value FROM slots GROUP BY category
                HAVING count(DISTINCT "{g}") + (count(*) FILTER (WHERE "{g}" IS NULL) > 0)::INTEGER = 1"""
            for g in ("Hourly", "Daily", "Monthly", "Yearly")
        ),
        slots="""SELECT *, source || '-' || "Hourly" AS category FROM flagged""",
    ),
)
def single_grain_report(spark, d):
    slot = F.concat_ws("-", "source", F.col("Hourly").cast("string"))
    return S.single_grain_report(D.flagged(spark, d).withColumn("slot", slot), "slot")


def _hist_sql(x: str, source: str, by: str = "", bins: int = 50) -> str:
    keys, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}bin, lo + bin * ((hi - lo) / {bins}) AS left, count(*) AS count,
                      count(*) / (n * ((hi - lo) / {bins})) AS density
               FROM (SELECT {keys}lo, hi, n, least(floor(({x} - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin
                     FROM {source} JOIN (SELECT {keys}min({x}) AS lo, max({x}) AS hi, count({x})::DOUBLE AS n
                                         FROM {source} {group}) {using}
                     WHERE {x} IS NOT NULL)
               GROUP BY {keys}bin, lo, hi, n"""


@register("histogram", with_tables("readings", _hist_sql("pm", "readings")), "left, density")
def histogram(spark, d):
    return S.histogram(D.readings(spark, d), "pm")


@register(
    "histogram_by_category",
    with_tables("readings", _hist_sql("pm", "readings", "source", 20)),
    "left, density",
)
def histogram_by_category(spark, d):
    return S.histogram(D.readings(spark, d), "pm", ["source"], 20)


@register(
    "density_curve",
    with_tables(
        "readings",
        """SELECT point::INTEGER AS point, lo - 3 * h + (hi - lo + 6 * h) * point / 127 AS x,
                  sum(exp(-0.5 * ((lo - 3 * h + (hi - lo + 6 * h) * point / 127 - pm) / h) ** 2)
                      / (h * n * sqrt(2 * pi()))) AS density
           FROM readings, (SELECT unnest(range(0, 128)) AS point),
                (SELECT min(pm) AS lo, max(pm) AS hi, count(pm)::DOUBLE AS n,
                        stddev_samp(pm) * count(pm)::DOUBLE ** (-0.2) AS h FROM readings)
           WHERE pm IS NOT NULL GROUP BY ALL""",
    ),
    "x, density",
)
def density_curve(spark, d):
    return S.density_curve(D.readings(spark, d), "pm")


def _stages(spark, d):
    r = D.readings(spark, d).select(F.to_date("time").alias("Daily"), "pm", "value")
    return S.before_after(r, zscore_filter(r, ["pm"]), ["pm", "value"], "Daily", 10)


STAGES = {
    "kept": """SELECT * FROM readings
               WHERE abs((pm - (SELECT avg(pm) FROM readings)) / (SELECT stddev_pop(pm) FROM readings)) < 4""",
    "stages": """SELECT stage, variable, "Daily", value FROM
                 (SELECT 'original' AS stage, time::DATE AS "Daily", pm, value FROM readings
                  UNION ALL SELECT 'removed_outliers', time::DATE, pm, value FROM kept)
                 UNPIVOT INCLUDE NULLS (value FOR variable IN (pm, value))""",
}


@register(
    "before_after_distribution",
    with_tables("readings", _hist_sql("value", "stages", "stage, variable", 10), **STAGES),
    "left, density",
)
def before_after_distribution(spark, d):
    return _stages(spark, d)[0]


@register(
    "before_after_series",
    with_tables(
        "readings",
        'SELECT stage, variable, "Daily", avg(value) AS value FROM stages GROUP BY ALL',
        **STAGES,
    ),
    "value",
)
def before_after_series(spark, d):
    return _stages(spark, d)[1]


@register(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM lineitem GROUP BY ALL"
        for a, b in (
            ("l_quantity", "l_extendedprice"),
            ("l_quantity", "l_discount"),
            ("l_extendedprice", "l_discount"),
        )
    ),
    "corr",
)
def correlation_matrix(spark, d):
    return S.correlation_matrix(
        D.table(spark, d, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount"],
        ["l_returnflag"],
    )


@register(
    "linear_fit",
    """SELECT year(l_shipdate)::INTEGER AS year, round_even(regr_slope(l_extendedprice, l_quantity), 1) AS slope,
              round_even(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept,
              round_even(corr(l_quantity, l_extendedprice), 3) AS corr,
              least(min(l_quantity), min(l_extendedprice)) AS axis_min,
              greatest(max(l_quantity), max(l_extendedprice)) AS axis_max
       FROM lineitem GROUP BY 1""",
)
def linear_fit(spark, d):
    li = D.table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return S.linear_fit(li, "l_quantity", "l_extendedprice", ["year"])


@register(
    "linear_fit_overall",
    with_tables(
        "readings",
        """SELECT round_even(regr_slope(pm, x), 1) AS slope, round_even(regr_intercept(pm, x), 1) AS intercept,
                  round_even(corr(x, pm), 3) AS corr, least(min(x), min(pm)) AS axis_min,
                  greatest(max(x), max(pm)) AS axis_max
           FROM (SELECT pm, value * 2 + sensor_id AS x FROM readings)""",
    ),
)
def linear_fit_overall(spark, d):
    r = D.readings(spark, d).withColumn("x", F.col("value") * 2 + F.col("sensor_id"))
    return S.linear_fit(r, "x", "pm")


@register(
    "two_axis_series",
    """SELECT o_orderdate, axis, series, avg(value) AS value FROM
       (SELECT o_orderdate, 1 AS axis, 'o_totalprice' AS series, o_totalprice AS value FROM orders
        UNION ALL SELECT o_orderdate, 2, 'o_custkey', o_custkey::DOUBLE FROM orders) GROUP BY ALL""",
    {"value": 6},
)
def two_axis_series(spark, d):
    return S.two_axis_series(D.table(spark, d, "orders"), "o_orderdate", ["o_totalprice"], ["o_custkey"])


@register(
    "melt_long",
    """SELECT l_shipdate AS "Daily", variable, value FROM
       (SELECT l_shipdate, l_quantity, l_discount FROM lineitem)
       UNPIVOT (value FOR variable IN (l_quantity, l_discount))""",
)
def melt_long(spark, d):
    li = D.table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "Daily")
    return S.melt(li, ["Daily"], ["l_quantity", "l_discount"])


FIVE = """min({x})::DOUBLE AS min, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
          quantile_cont({x}, 0.75) AS q3, max({x})::DOUBLE AS max"""


@register(
    "five_number_summary",
    " UNION ALL ".join(
        f"SELECT {year} AS year, '{c}' AS variable, {FIVE.format(x=c)} FROM lineitem GROUP BY 1"
        for c in ("l_extendedprice", "l_tax")
        for year in ("year(l_shipdate)::VARCHAR", "'All'")
    ),
    {"q1": 6, "median": 6, "q3": 6},
)
def five_number_summary(spark, d):
    li = D.table(spark, d, "lineitem").withColumn("Year", F.year("l_shipdate"))
    return S.five_number_summary(li, ["l_extendedprice", "l_tax"], "Year")


@register(
    "heatmap_matrix",
    """WITH days AS (SELECT o_orderdate::DATE AS "Daily", avg(o_totalprice) AS a, max(o_totalprice) AS b
                     FROM orders GROUP BY 1),
            season AS (SELECT * FROM days WHERE month("Daily") BETWEEN 4 AND 9 AND year("Daily") > 1997)
       SELECT "Daily", a, b, year("Daily")::INTEGER AS year, (SELECT least(min(a), min(b)) FROM season) AS vmin,
              (SELECT greatest(max(a), max(b)) FROM season) AS vmax FROM season""",
    {"a": 6, "vmin": 6, "vmax": 6},
)
def heatmap_matrix(spark, d):
    days = (
        D.table(spark, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("Daily"))
        .agg(F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    )
    return S.heatmap_matrix(days, "Daily", ["a", "b"], after_year=1997)
