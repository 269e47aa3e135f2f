"""Aggregations, windows, top values and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import schemas
from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.functions.calendar import calendar_features
from hazegrid.operators import aggregates as A
from hazegrid.operators.deciles import attach_quantile, top_decile_flag
from hazegrid.operators.joins import append_rows, with_all_bucket
from hazegrid.plans import sites as S
from hazegrid.plans.community import neighborhood_table

STATS = """median({v}) AS median, avg({v}) AS mean, max({v}) AS max,
           coalesce(sum({v}), 0)::DOUBLE AS sum, count(*) AS count"""


def shares(weight: str = "1") -> str:
    parts = {
        "harmful": f"sum({weight}) FILTER (WHERE harmful = 1 AND not_harmful IS NOT NULL)",
        "not_harmful": f"sum({weight}) FILTER (WHERE not_harmful = 1 AND harmful IS NOT NULL)",
    }
    total = f"sum({weight}) FILTER (WHERE harmful IS NOT NULL AND not_harmful IS NOT NULL)"
    return ", ".join(
        f"CASE WHEN {total} IS NOT NULL THEN coalesce({p}, 0)::DOUBLE / {total} END AS {n}"
        for n, p in parts.items()
    )


# Half-hour hexagon table used by the daily rollups: the sensor's own small cell.
def cells_table(spark, d):
    f = D.flagged(spark, d).where("source = 'AQ'").withColumnRenamed("sensor_id", "hexagon_id")
    # Nothing that is rolled up reads a cell's median.
    return calendar_features(A.cell_stats(f, "hexagon_id", "thirtymins", "pm", quantiles={}), "thirtymins")


CELLS = """SELECT sensor_id AS hexagon_id, thirtymins, thirtymins::DATE AS "Daily", harmful, not_harmful,
                   median(pm) AS median, avg(pm) AS mean, max(pm) AS max, min(pm) AS min, sum(pm) AS sum,
                   count(*) AS count
            FROM flagged WHERE source = 'AQ' AND harmful IS NOT NULL AND not_harmful IS NOT NULL
            GROUP BY sensor_id, thirtymins, harmful, not_harmful"""


@register(
    "summary_value_mode",
    with_tables("flagged", f'SELECT "Daily", sensor_id, {STATS.format(v="pm")} FROM flagged GROUP BY ALL'),
    "median, mean, sum",
)
def summary_value_mode(spark, d):
    return A.summarize(D.flagged(spark, d), ["Daily"], ["sensor_id"], value="pm")


@register(
    "summary_value_mode_hot",
    with_tables("readings", f'SELECT source, {STATS.format(v="pm")} FROM readings GROUP BY ALL'),
    "median, mean, sum",
)
def summary_value_mode_hot(spark, d):
    """Few large groups, a third of all rows each."""
    return A.grouped_stats(D.readings(spark, d), ["source"], "pm")


@register(
    "summary_rollup_mode",
    with_tables(
        "flagged",
        """SELECT "Daily", sum(sum) AS sum, sum(count)::BIGINT AS count, max(max) AS max,
                  sum(sum) / sum(count) AS mean
           FROM (SELECT "Daily", sensor_id, coalesce(sum(pm), 0) AS sum, count(*) AS count, max(pm) AS max
                 FROM flagged GROUP BY ALL) GROUP BY "Daily" """,
    ),
    "sum, mean",
)
def summary_rollup_mode(spark, d):
    # Sums, counts and maxima of the sensors' days; no median is read.
    per_sensor = A.grouped_stats(D.flagged(spark, d), ["Daily", "sensor_id"], "pm", ("sum", "count", "max"), {})
    return A.summarize(per_sensor, ["Daily"], [], ["sum", "count"], ["max"])


@register(
    "cell_stats_30min",
    with_tables("flagged", 'SELECT * EXCLUDE ("Daily") FROM cells', cells=CELLS),
    "median, mean, sum",
)
def cell_stats_30min(spark, d):
    f = D.flagged(spark, d).where("source = 'AQ'").withColumnRenamed("sensor_id", "hexagon_id")
    return A.cell_stats(f, "hexagon_id", "thirtymins", "pm")


def _profile_sql(keys: list[str], value: str, seen: str, source: str) -> str:
    quoted = ", ".join(f'"{k}"' for k in keys)
    return f"""SELECT {quoted}, median("{value}") AS "{value}|median", avg("{value}") AS "{value}|mean",
                      max("{value}") AS "{value}|max", coalesce(sum("{value}"), 0)::DOUBLE AS "{value}|sum",
                      count(*) AS "{value}|count", min("{seen}") AS "{seen}|min", max("{seen}") AS "{seen}|max"
               FROM {source} GROUP BY ALL"""


EPA_PROFILE = _profile_sql(schemas.EPA_SITE_KEYS, "sample_measurement", "Full Date", "epa_raw")
PA_PROFILE = _profile_sql(schemas.PURPLEAIR_SITE_KEYS, S.PM, "created_at", "pa_typed")


def profile_digits(value: str) -> dict[str, int]:
    return {f"{value}|median": 9, f"{value}|mean": 9, f"{value}|sum": 6}


@register(
    "epa_site_profile", with_tables("epa_raw", EPA_PROFILE), profile_digits("sample_measurement")
)
def epa_site_profile(spark, d):
    typed = S.epa_typed(D.epa_raw(spark, d))
    return A.site_profile(typed, schemas.EPA_SITE_KEYS, "sample_measurement", "Full Date")


@register("purpleair_site_profile", with_tables("pa_typed", PA_PROFILE), profile_digits(S.PM))
def purpleair_site_profile(spark, d):
    typed = S.purpleair_typed(D.purpleair_raw(spark, d))
    return A.site_profile(typed, schemas.PURPLEAIR_SITE_KEYS, S.PM, "created_at")


@register(
    "flatten_stat_names",
    """SELECT c_mktsegment, median(c_acctbal) AS "c_acctbal|median", avg(c_acctbal) AS "c_acctbal|mean",
               max(c_acctbal) AS "c_acctbal|max", sum(c_acctbal) AS "c_acctbal|sum",
               count(*) AS "c_acctbal|count", min(c_name) AS "c_name|min", max(c_name) AS "c_name|max"
        FROM customer GROUP BY ALL""",
    {"c_acctbal|median": 6, "c_acctbal|mean": 7, "c_acctbal|sum": 4},
)
def flatten_stat_names(spark, d):
    return A.site_profile(D.table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_name")


@register(
    "inner_join_stats_dates",
    """SELECT o_custkey, median(o_totalprice) AS "o_totalprice|median", avg(o_totalprice) AS "o_totalprice|mean",
              max(o_totalprice) AS "o_totalprice|max", sum(o_totalprice) AS "o_totalprice|sum",
              count(*) AS "o_totalprice|count", min(o_orderdate) AS "o_orderdate|min",
              max(o_orderdate) AS "o_orderdate|max" FROM orders GROUP BY ALL""",
    {"o_totalprice|median": 6, "o_totalprice|mean": 6, "o_totalprice|sum": 4},
)
def inner_join_stats_dates(spark, d):
    """Statistics and first/last date of the same keys: one aggregation, no join."""
    return A.site_profile(D.table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderdate")


@register(
    "harmful_share",
    with_tables("flagged", f'SELECT "Daily", sensor_id, {shares()} FROM flagged GROUP BY ALL'),
    "harmful, not_harmful",
)
def harmful_share(spark, d):
    return A.harmful_share(D.flagged(spark, d), ["Daily", "sensor_id"])


@register(
    "harmful_share_weighted",
    with_tables(
        "flagged",
        f"""SELECT "Daily", max(max) AS max, sum(sum) AS sum, sum(count)::BIGINT AS count,
                   sum(sum) / sum(count) AS mean, {shares('count')} FROM cells GROUP BY "Daily" """,
        cells=CELLS,
    ),
    "harmful, not_harmful, sum, mean",
)
def harmful_share_weighted(spark, d):
    return A.summary_with_shares(cells_table(spark, d), ["Daily"], sums=["sum", "count"], maxes=["max"])


CELL_ROLLUP = f"""
    SELECT a.*, c.harmful_hex, c.not_harmful_hex, c.hex_ct FROM
      (SELECT "Daily", max(max) AS max, sum(sum) AS sum, sum(count)::BIGINT AS count,
              sum(sum) / sum(count) AS mean, {shares('count')} FROM cells GROUP BY "Daily") a
    JOIN (SELECT "Daily", avg((m >= 35)::INTEGER) AS harmful_hex, avg((m <= 12)::INTEGER) AS not_harmful_hex,
                 count(*) AS hex_ct
          FROM (SELECT "Daily", hexagon_id, sum(sum) / sum(count) AS m FROM cells GROUP BY ALL)
          GROUP BY "Daily") c USING ("Daily")"""


@register(
    "harmful_cell_share",
    with_tables("flagged", CELL_ROLLUP, cells=CELLS),
    "harmful, not_harmful, sum, mean, harmful_hex, not_harmful_hex",
)
def harmful_cell_share(spark, d):
    return A.rollup_with_cell_shares(cells_table(spark, d), ["Daily"], "hexagon_id")


@register(
    "distinct_cell_count",
    with_tables(
        "flagged",
        """SELECT "Daily", count(DISTINCT hexagon_id) AS hex_ct FROM cells GROUP BY "Daily" """,
        cells=CELLS,
    ),
)
def distinct_cell_count(spark, d):
    return A.distinct_cell_count(cells_table(spark, d), ["Daily"], "hexagon_id")


EPA_FLAGS = """SELECT *, "Full Date"[1:10]::DATE AS "Daily",
                 CASE WHEN sample_measurement >= 35 THEN 1 WHEN sample_measurement < 35 THEN 0 END AS harmful,
                 CASE WHEN sample_measurement <= 12 THEN 1 WHEN sample_measurement > 12 THEN 0 END AS not_harmful
               FROM epa_raw"""
EPA_DAILY = f"""SELECT "Daily", value_represented, latitude, longitude,
                {STATS.format(v='sample_measurement')}, {shares()} FROM epa_flags GROUP BY ALL"""


@register(
    "epa_daily_agg",
    with_tables("epa_raw", EPA_DAILY, epa_flags=EPA_FLAGS),
    "median, mean, sum, harmful, not_harmful",
)
def epa_daily_agg(spark, d):
    return S.epa_daily(S.process_epa(D.epa_raw(spark, d))[0])


PA_CLEAN = {
    "outdoor": """SELECT *, "PM2.5 (ATM)" AS v FROM pa_typed
           WHERE address IN (SELECT address FROM pa_typed WHERE device_loc = 'outside')
              OR "ParentID" IN (SELECT "ID" FROM pa_typed WHERE device_loc = 'outside')""",
    "pa_clean": """SELECT *, time::DATE AS "Daily",
                     CASE WHEN v >= 35 THEN 1 WHEN v < 35 THEN 0 END AS harmful,
                     CASE WHEN v <= 12 THEN 1 WHEN v > 12 THEN 0 END AS not_harmful
                   FROM outdoor
                   WHERE abs((v - (SELECT avg(v) FROM outdoor)) / (SELECT stddev_pop(v) FROM outdoor)) < 4""",
}
PA_DAILY = f"""SELECT "Daily", address, lat, lon, {STATS.format(v='v')}, {shares()} FROM pa_clean
               WHERE "Daily" >= DATE '2024-01-03' GROUP BY ALL"""


@register(
    "purpleair_daily_agg",
    with_tables("pa_typed", PA_DAILY, **PA_CLEAN),
    "median, mean, sum, harmful, not_harmful",
)
def purpleair_daily_agg(spark, d):
    clean, _ = S.process_purpleair(D.purpleair_raw(spark, d))
    return S.purpleair_daily(clean, "2024-01-03")


@register(
    "neighborhood_30min_agg",
    with_tables(
        "flagged places",
        f"""SELECT pri_neigh, thirtymins, geoid10, lat_r, lng_r, {STATS.format(v='pm')} FROM
            (SELECT p.pri_neigh, thirtymins, '17031' || lpad(sensor_id::VARCHAR, 10, '0') AS geoid10,
                    round_even(lat, 5) AS lat_r, round_even(lon, 5) AS lng_r, pm
             FROM flagged f JOIN places p
               ON p.nx = (f.sensor_id % 15) // 3 AND p.ny = (f.sensor_id // 15) // 2)
            GROUP BY ALL""",
    ),
    "median, mean, sum",
)
def neighborhood_30min_agg(spark, d):
    s = F.col("sensor_id")
    nx, ny = F.floor((s % 15) / 3), F.floor(F.floor(s / 15) / 2)
    f = D.flagged(spark, d).withColumn("n_nationkey", ((nx + 5 * ny) % 25).cast("int"))
    named = D.join_lookup(f, D.table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    tagged = named.select(
        F.concat_ws("-", "n_name", ny.cast("string")).alias("pri_neigh"),
        F.concat(F.lit("17031"), F.lpad(s.cast("string"), 10, "0")).alias("geoid10"),
        "thirtymins",
        "lat",
        F.col("lon").alias("lng"),
        F.col("pm").alias("value"),
    )
    return neighborhood_table(tagged)


@register(
    "group_mean_median",
    """SELECT o_orderpriority, median(o_totalprice) AS median, avg(o_totalprice) AS mean,
              avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders) AS diff_from_group_mean
       FROM orders GROUP BY ALL""",
    {"median": 4, "mean": 4, "diff_from_group_mean": 4},
)
def group_mean_median(spark, d):
    return A.group_mean_median(D.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@register(
    "group_rates",
    """SELECT l_returnflag, (count(*) FILTER (WHERE l_linestatus = 'F'))::DOUBLE / count(*) AS "F",
              (count(*) FILTER (WHERE l_linestatus = 'O'))::DOUBLE / count(*) AS "O"
       FROM lineitem GROUP BY ALL""",
    "F, O",
)
def group_rates(spark, d):
    return A.group_rates(D.table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"])


@register(
    "group_rate_vectors",
    """WITH numbered AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i
                         FROM (SELECT DISTINCT l_partkey FROM lineitem)),
       rates AS (SELECT l_returnflag, i, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS rate
                 FROM lineitem JOIN numbered USING (l_partkey) GROUP BY l_returnflag, i)
       SELECT l_returnflag, (SELECT count(*) FROM numbered) AS size, i AS index, rate FROM rates""",
    {"rate": 9},
)
def group_rate_vectors(spark, d):
    """One sparse vector a group, over more outcomes than a table could have columns."""
    made, _ = A.group_rate_vectors(D.table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")
    entries = F.explode(F.arrays_zip("rates.indices", "rates.values")).alias("e")
    return made.select("l_returnflag", "rates.size", entries).select("l_returnflag", "size", F.col("e.indices").alias("index"), F.col("e.values").alias("rate"))


@register(
    "group_rates_long",
    """SELECT l_returnflag, l_partkey AS outcome, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS rate
       FROM lineitem GROUP BY l_returnflag, l_partkey""",
    {"rate": 9},
)
def group_rates_long(spark, d):
    """More outcomes than a table could have columns."""
    return A.group_rates_long(D.table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


@register(
    "bucket_agg",
    with_tables("flagged", 'SELECT "Daily", sum(pm) AS pm FROM flagged GROUP BY ALL'),
    {"pm": 6},
)
def bucket_agg(spark, d):
    return A.bucket_agg(D.flagged(spark, d), ["Daily"], "pm", "sum")


GRAINS = ["Hourly", "Monthly", "Yearly", "MonthYear", "Daily", "thirtymins"]


@register(
    "bucket_agg_by_category",
    with_tables(
        "flagged",
        " UNION ALL ".join(
            f"""SELECT source, '{g}' AS grain, "{g}"::VARCHAR AS bucket, avg(pm) AS pm
                FROM flagged GROUP BY ALL"""
            for g in GRAINS
        ),
    ),
    "pm",
)
def bucket_agg_by_category(spark, d):
    return A.bucket_agg_by_grain(D.flagged(spark, d), "source", GRAINS, "pm")


@register(
    "neighborhood_summary",
    """SELECT o_orderpriority AS pri_neigh, sum(s) AS sum, sum(c)::BIGINT AS count, count(*) AS timevar_count,
              sum(s) / sum(c) AS mean
       FROM (SELECT o_orderpriority, o_orderdate::DATE, sum(o_totalprice) AS s, count(*) AS c
             FROM orders GROUP BY ALL) GROUP BY o_orderpriority""",
    {"sum": 2, "mean": 4},
)
def neighborhood_summary(spark, d):
    daily = (
        D.table(spark, d, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("pri_neigh"),
            "o_orderstatus",
            F.to_date("o_orderdate").alias("Daily"),
        )
        .agg(F.sum("o_totalprice").alias("sum"), F.count(F.lit(1)).alias("count"))
    )
    return A.neighborhood_summary(daily, "pri_neigh", "Daily")


@register(
    "year_span",
    """SELECT min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year
       FROM orders""",
)
def year_span(spark, d):
    return A.year_span(D.table(spark, d, "orders"), "o_orderdate")


@register(
    "sort_by_mean",
    """SELECT l_suppkey, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL ORDER BY mean, l_suppkey""",
    {"mean": 4},
)
def sort_by_mean(spark, d):
    means = D.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean"))
    return means.orderBy(F.asc("mean"), F.asc("l_suppkey"))


@register(
    "top_values",
    """SELECT p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type LIMIT 9""",
)
def top_values(spark, d):
    return A.top_values(D.table(spark, d, "part"), "p_type", 9)


@register(
    "top_values_all",
    """SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def top_values_all(spark, d):
    return A.top_values(D.table(spark, d, "lineitem"), "l_shipdate", None)


@register(
    "map_center",
    with_tables(
        "readings",
        """SELECT round_even(median(lat), 4) AS lat_center, round_even(median(lon), 4) AS lon_center
           FROM readings""",
    ),
)
def map_center(spark, d):
    return A.map_center(D.readings(spark, d), "lat", "lon")


MONTHS = """SELECT date_trunc('month', o_orderdate)::DATE AS "MonthYear", o_custkey,
                   round(sum(o_totalprice) / count(*), 9) AS mean, count(*) AS count
            FROM orders GROUP BY ALL"""


def _month_means(spark, d):
    o = calendar_features(D.table(spark, d, "orders"), "o_orderdate", hourly=False, daily=False)
    return o.groupBy("MonthYear", "o_custkey").agg(
        F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("count")
    )


@register(
    "top_decile_flag",
    f"""WITH m AS ({MONTHS}), q AS (SELECT "MonthYear", quantile_cont(mean, 0.9) AS q FROM m GROUP BY ALL)
        SELECT m.*, CASE WHEN mean >= q THEN 'Top 10%' ELSE 'Low 90%' END AS cat
        FROM m JOIN q USING ("MonthYear")""",
    {"mean": 4},
)
def top_decile(spark, d):
    return top_decile_flag(_month_means(spark, d), ["MonthYear"])


@register(
    "decile_back_join",
    f"""WITH m AS ({MONTHS}), q AS (SELECT "MonthYear", quantile_cont(mean, 0.9) AS top10 FROM m GROUP BY ALL)
        SELECT m.*, top10 FROM m JOIN q USING ("MonthYear")""",
    {"mean": 4, "top10": 4},
)
def decile_back_join(spark, d):
    return attach_quantile(_month_means(spark, d), ["MonthYear"], "mean")


@register(
    "append_increment",
    """SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN o_orderpriority END
              AS o_orderpriority FROM orders""",
)
def append_increment(spark, d):
    o = D.table(spark, d, "orders")
    old = o.where("o_orderdate < timestamp_ntz'1999-01-01'").select("o_orderkey", "o_orderdate")
    new = o.where("o_orderdate >= timestamp_ntz'1999-01-01'").select(
        "o_orderkey", "o_orderdate", "o_orderpriority"
    )
    return append_rows(old, new)


@register(
    "all_bucket_union",
    with_tables(
        "flagged",
        """SELECT DISTINCT sensor_id, source, "Daily"::VARCHAR AS "Daily", "Hourly"::VARCHAR AS "Hourly" FROM flagged
           UNION SELECT DISTINCT sensor_id, source, 'All', 'All' FROM flagged""",
    ),
)
def all_bucket_union(spark, d):
    f = D.flagged(spark, d).select("sensor_id", "source", "Daily", "Hourly")
    return with_all_bucket(f, ["Daily", "Hourly"])
