"""Projection, casts, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.functions import calendar as C
from hazegrid.functions import clean
from hazegrid.functions.rounding import half_even
from hazegrid.operators import filters as O
from hazegrid.operators.joins import outdoor_only
from hazegrid.operators.quantiles import number_rows
from hazegrid.plans.sites import process_purpleair, purpleair_typed

# ---- projection, casts, cleaning -------------------------------------------


@register("cast_str", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, c_name FROM customer")
def cast_str(spark, d):
    df = D.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return clean.cast_present(df, ["c_custkey", "c_nationkey", "c_name", "absent"], "string")


@register(
    "cast_double",
    with_tables("readings", "SELECT event_id, pm AS pm_text, sensor_id::DOUBLE AS sensor_id FROM readings"),
)
def cast_double(spark, d):
    r = D.readings(spark, d).select("event_id", F.col("pm").cast("string").alias("pm_text"), "sensor_id")
    return clean.cast_present(r, ["pm_text", "sensor_id", "absent"], "double")


@register(
    "cast_int",
    with_tables("readings", "SELECT event_id, trunc(value)::BIGINT AS value, sensor_id FROM readings"),
)
def cast_int(spark, d):
    r = D.readings(spark, d).select("event_id", "value", F.col("sensor_id").cast("string").alias("sensor_id"))
    return clean.cast_present(r, ["value", "sensor_id"], "bigint", required=True)


@register("parse_timestamp", with_tables("points", "SELECT id, time FROM points"))
def parse_timestamp(spark, d):
    return C.parse_timestamps(D.community_points(spark, d).select("id", "time"), ["time"])


@register(
    "concat_datetime",
    with_tables(
        "epa_raw",
        """SELECT event_id, CASE WHEN sample_measurement IS NOT NULL THEN "Full Date" END AS "Full Date"
           FROM epa_raw""",
    ),
)
def concat_datetime(spark, d):
    e = D.epa_raw(spark, d)
    time = F.when(F.col("sample_measurement").isNotNull(), F.col("time_local"))
    return e.select("event_id", C.join_date_and_time(F.col("date_local"), time).alias("Full Date"))


@register("parse_point_tuple", with_tables("pa_typed", "SELECT event_id, lat, lon FROM pa_typed"))
def parse_point_tuple(spark, d):
    lat, lon = clean.parse_point(F.col("location"))
    return D.purpleair_raw(spark, d).select("event_id", lat.alias("lat"), lon.alias("lon"))


@register(
    "coalesce_parent_id",
    with_tables("pa_typed", 'SELECT event_id, "ID", "ParentID", device_loc FROM pa_typed'),
)
def coalesce_parent_id(spark, d):
    raw = D.purpleair_raw(spark, d).select("event_id", "ID", "ParentID", "device_loc")
    return clean.fill_parent(raw, "ID", "ParentID", "device_loc")


@register(
    "code_prefix",
    with_tables("block_edges", "SELECT DISTINCT pid AS geoid10, pid[1:12] AS geo_12 FROM block_edges"),
)
def code_prefix(spark, d):
    b = D.blocks(spark, d).select("geoid10")
    return b.withColumn("geo_12", clean.code_prefix(F.col("geoid10")))


@register(
    "canonical_code",
    with_tables("sensors", "SELECT sensor_id, (170310000000000 + sensor_id)::VARCHAR AS geoid10 FROM sensors"),
)
def canonical_code(spark, d):
    """Codes that went through a float text, as old files have them."""
    s = D.sensors(spark, d)
    text = F.concat((F.lit(170310000000000) + F.col("sensor_id")).cast("string"), F.lit(".0"))
    return s.select("sensor_id", clean.canonical_code(text).alias("geoid10"))


@register(
    "project_rename",
    'SELECT s_suppkey AS "Supplier", s_name AS "Supplier Name", s_acctbal FROM supplier',
)
def project_rename(spark, d):
    return clean.rename_or_drop(
        D.table(spark, d, "supplier"),
        {"s_suppkey": "Supplier", "s_name": "Supplier Name"},
        ["s_nationkey"],
    )


@register(
    "round_half_even",
    with_tables(
        "readings",
        """SELECT event_id, round_even(lat, 4) AS lat_r, round_even(lon, 4) AS lng_r,
                  round_even(pm, 1) AS pm_1, round_even(event_id / 8.0::DOUBLE, 2) AS eighth
           FROM readings""",
    ),
)
def round_half_even(spark, d):
    return D.readings(spark, d).select(
        "event_id",
        half_even(F.col("lat"), 4).alias("lat_r"),
        half_even(F.col("lon"), 4).alias("lng_r"),
        half_even(F.col("pm"), 1).alias("pm_1"),
        half_even(F.col("event_id") / 8.0, 2).alias("eighth"),
    )


@register(
    "calendar_to_string",
    with_tables(
        "flagged",
        """SELECT event_id, "Hourly"::VARCHAR AS "Hourly", "Monthly"::VARCHAR AS "Monthly",
                  "Yearly"::VARCHAR AS "Yearly", strftime("Daily", '%Y-%m-%d') AS "Daily",
                  strftime("MonthYear", '%Y-%m-%d') AS "MonthYear" FROM flagged""",
    ),
)
def calendar_to_string(spark, d):
    f = D.flagged(spark, d).select("event_id", *C.CALENDAR)
    return C.calendar_to_text(f, ["Hourly", "Monthly", "Yearly"], ["Daily", "MonthYear"])


@register(
    "tag_source",
    with_tables(
        "readings",
        """SELECT event_id, pm, CASE source WHEN 'AQ' THEN 'AirQuality' WHEN 'EPA' THEN 'EPA' ELSE 'PurpleAir' END
                  AS "Source" FROM readings""",
    ),
)
def tag_source(spark, d):
    """Each network's readings under its name, one below the other."""
    r, names = D.readings(spark, d), {"AQ": "AirQuality", "EPA": "EPA", "PA": "PurpleAir"}
    tagged = [r.where(F.col("source") == s).select("event_id", "pm", F.lit(n).alias("Source")) for s, n in names.items()]
    return tagged[0].union(tagged[1]).union(tagged[2])


@register(
    "row_id_within_filter",
    with_tables(
        "places readings",
        """SELECT event_id, pri_neigh,
                  row_number() OVER (PARTITION BY pri_neigh ORDER BY event_id) - 1 AS id
           FROM readings r JOIN places p
             ON p.nx = (r.sensor_id % 15) // 3 AND p.ny = (r.sensor_id // 15) // 2""",
    ),
)
def row_id_within_filter(spark, d):
    s = F.col("sensor_id")
    nx, ny = F.floor((s % 15) / 3), F.floor(F.floor(s / 15) / 2)
    nation = D.table(spark, d, "nation")
    r = D.readings(spark, d).withColumn("n_nationkey", ((nx + 5 * ny) % 25).cast("int"))
    named = D.join_lookup(r, nation.select("n_nationkey", "n_name"), ["n_nationkey"]).select(
        "event_id", F.concat_ws("-", "n_name", ny.cast("string")).alias("pri_neigh")
    )
    return number_rows(named, ["pri_neigh"], "event_id", "id")


# ---- filters -----------------------------------------------------------------


@register(
    "category_filter",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def category_filter(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return O.category_filter(
        o, {"o_orderstatus": ["O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    )


@register(
    "range_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05""",
)
def range_filter(spark, d):
    li = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return O.range_filter(li, {"l_quantity": [10, 20], "l_discount": [0.02, 0.05]})


@register(
    "date_cutoff",
    with_tables("readings", "SELECT event_id, time FROM readings WHERE time <= TIMESTAMP '2024-01-15'"),
)
def date_cutoff(spark, d):
    return O.date_cutoff(D.readings(spark, d).select("event_id", "time"), "time", "2024-01-15")


@register(
    "date_floor_filter",
    """SELECT o_orderkey, o_orderdate::DATE AS "Daily" FROM orders
       WHERE o_orderdate::DATE >= DATE '1998-03-01'""",
)
def date_floor_filter(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("Daily"))
    return O.date_floor(o, "Daily", "1998-03-01")


_BOX = (-87.85, 41.7, -87.7, 41.85)


@register(
    "bbox_filter",
    with_tables(
        "readings",
        f"""SELECT event_id, lon, lat FROM
            (SELECT event_id, lon, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE lat END AS lat FROM readings)
            WHERE lon BETWEEN {_BOX[0]}::DOUBLE AND {_BOX[2]}::DOUBLE
              AND lat BETWEEN {_BOX[1]}::DOUBLE AND {_BOX[3]}::DOUBLE AND lat <> 0 AND lon <> 0""",
    ),
)
def bbox_filter(spark, d):
    lat = F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("lat"))
    r = D.readings(spark, d).select("event_id", "lon", lat.alias("lat"))
    return O.bbox_filter(r, "lon", "lat", *_BOX)


@register(
    "season_filter",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE month(o_orderdate) IN (4, 5, 6, 7, 8, 9) AND year(o_orderdate) > 1997""",
)
def season_filter(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return O.season_filter(o, "o_orderdate", after_year=1997)


@register(
    "drop_any_null",
    with_tables(
        "readings",
        """SELECT event_id, pm, other FROM
           (SELECT event_id, pm, CASE WHEN event_id % 7 <> 0 THEN value END AS other FROM readings)
           WHERE pm IS NOT NULL AND other IS NOT NULL""",
    ),
)
def drop_any_null(spark, d):
    other = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("other")
    return O.drop_any_null(D.readings(spark, d).select("event_id", "pm", other), ["pm", "other"])


@register(
    "min_count_filter",
    with_tables(
        "readings",
        """SELECT sensor_id, time::DATE AS "Daily", count(*) AS count, count(pm) AS known
           FROM readings GROUP BY ALL HAVING count(*) >= 3 AND count(pm) >= 2""",
    ),
)
def min_count_filter(spark, d):
    daily = (
        D.readings(spark, d)
        .groupBy("sensor_id", F.to_date("time").alias("Daily"))
        .agg(F.count(F.lit(1)).alias("count"), F.count("pm").alias("known"))
    )
    return O.min_support(daily, {"count": 3, "known": 2})


@register(
    "outdoor_only_filter",
    with_tables(
        "pa_typed",
        """SELECT event_id, address, "ParentID" FROM pa_typed
           WHERE address IN (SELECT address FROM pa_typed WHERE device_loc = 'outside')
              OR "ParentID" IN (SELECT "ID" FROM pa_typed WHERE device_loc = 'outside')""",
    ),
)
def outdoor_only_filter(spark, d):
    typed = purpleair_typed(D.purpleair_raw(spark, d))
    places = typed.select("address", "ID", "device_loc").distinct()
    return outdoor_only(typed.select("event_id", "address", "ParentID"), places)


@register(
    "zscore_outlier_filter",
    with_tables(
        "readings",
        """SELECT event_id, pm FROM readings
           WHERE abs((pm - (SELECT avg(pm) FROM readings)) / (SELECT stddev_pop(pm) FROM readings)) < 4""",
    ),
)
def zscore_outlier_filter(spark, d):
    return O.zscore_filter(D.readings(spark, d).select("event_id", "pm"), ["pm"])


@register(
    "null_outlier_report",
    with_tables(
        "readings",
        """SELECT n_rows, n_all_null, n_not_null, n_kept, n_not_null - n_kept AS n_outliers,
                  round_even(n_all_null * 100.0::DOUBLE / n_rows, 3) AS pct_null,
                  round_even((1 - n_kept::DOUBLE / n_not_null) * 100, 3) AS pct_outliers,
                  round_even(n_kept * 100.0::DOUBLE / n_rows, 3) AS pct_kept
           FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE pm IS NULL) AS n_all_null,
                        count(pm) AS n_not_null, count(*) FILTER (WHERE abs((pm - m) / s) < 4) AS n_kept
                 FROM readings, (SELECT avg(pm) AS m, stddev_pop(pm) AS s FROM readings))""",
    ),
)
def null_outlier_report(spark, d):
    return O.zscore_report(D.readings(spark, d).select("event_id", "pm"), ["pm"])


@register(
    "distinct_rows",
    with_tables("readings", "SELECT DISTINCT sensor_id, lat, lon FROM readings"),
)
def distinct_rows(spark, d):
    return O.distinct_rows(D.readings(spark, d).select("sensor_id", "lat", "lon"))


@register(
    "distinct_keys",
    with_tables("readings", 'SELECT DISTINCT sensor_id, source, time::DATE AS "Daily" FROM readings'),
)
def distinct_keys(spark, d):
    r = D.readings(spark, d).select("sensor_id", "source", F.to_date("time").alias("Daily"))
    return O.distinct_rows(r, ["sensor_id", "source", "Daily"])


@register(
    "purpleair_outdoor_clean",
    with_tables(
        "pa_typed",
        """SELECT address, lat, lon, "ID", "ParentID", "PM2.5 (ATM)", "PM2.5 (CF=1)", created_at
           FROM outdoor
           WHERE abs(("PM2.5 (ATM)" - (SELECT avg("PM2.5 (ATM)") FROM outdoor))
                     / (SELECT stddev_pop("PM2.5 (ATM)") FROM outdoor)) < 4""",
        outdoor="""SELECT * FROM pa_typed
           WHERE address IN (SELECT address FROM pa_typed WHERE device_loc = 'outside')
              OR "ParentID" IN (SELECT "ID" FROM pa_typed WHERE device_loc = 'outside')""",
    ),
)
def purpleair_outdoor_clean(spark, d):
    return process_purpleair(D.purpleair_raw(spark, d))[0]
