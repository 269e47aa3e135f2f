"""User-level jobs over the derived sensor tables."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.aggs import EPA_DAILY, EPA_FLAGS, EPA_PROFILE, PA_CLEAN, PA_PROFILE, shares
from hazegrid.catalog.exprs import GRID, area_sql
from hazegrid.catalog.joins import TOUCH_SQL
from hazegrid.catalog.tables import inside_sql, with_tables
from hazegrid.functions import geometry as G
from hazegrid.functions.calendar import calendar_features
from hazegrid.functions.clean import parse_point
from hazegrid.operators import aggregates as A
from hazegrid.operators.profiling import QUARTILES
from hazegrid.operators.spatial import HexGrid, extent
from hazegrid.plans import community, compare, geodims, neighborhood, refresh, reports
from hazegrid.plans import sites as S
from hazegrid.session import materialize, new_path
from hazegrid.sources import tables

FIRST_DAY = "2024-01-01"
AQ_SUPPORT, EPA_SUPPORT, PA_SUPPORT = {"count": 80, "hex_ct": 5}, {"count": 62}, {"count": 90}

# ---- tables made by one job and read by the next -----------------------------


def tag_points(spark, d):
    """Geotagged points."""
    known = D.sensors(spark, d)
    areas = D.neighborhoods(spark, d, known)
    return community.tag_points(
        D.community_points(spark, d),
        D.blocks(spark, d, known),
        areas,
        D.hexagons(spark, d, known),
        HexGrid.over(extent(areas)),
    )


def tag_shapes(spark, d, known, blocks=None, hexagons=None):
    """Points with the ids of all three shape layers, without the regular grid, which needs an extent.

    A point in two shapes of one layer counts for both, so every layer is joined.
    """
    return community.tag_points(
        D.community_points(spark, d),
        blocks or D.blocks(spark, d, known),
        D.neighborhoods(spark, d, known),
        hexagons or D.hexagons(spark, d, known),
    )


def tagged_points(spark, d):
    """The same written, where several tables are made from them."""
    return materialize(tag_points(spark, d))


def by_hexagon(spark, d, tagged=None, known=None, hexagons=None):
    """Half-hour hexagon table as the daily tables read it, without its medians."""
    if tagged is None:
        tagged = tag_shapes(spark, d, known or D.sensors(spark, d), hexagons=hexagons)
    cells = A.cell_stats(tagged, "hexagon_id", "thirtymins", "value", quantiles={})
    return calendar_features(cells, "thirtymins")


def epa_daily(spark, d):
    return S.epa_daily(S.process_epa(D.epa_raw(spark, d))[0], quantiles={})


def purpleair_daily(spark, d):
    clean, _ = S.process_purpleair(D.purpleair_raw(spark, d))
    return S.purpleair_daily(clean, FIRST_DAY, quantiles={})


def neighborhood_rows(spark, d, tagged=None, blocks=None, known=None):
    """Neighborhood table as the drilldowns read it, without its medians."""
    if tagged is None:
        tagged = tag_shapes(spark, d, known or D.sensors(spark, d), blocks)
    return community.neighborhood_table(tagged, quantiles={})


HEX = {
    "flag_points": """SELECT *, time_bucket(INTERVAL '30 minutes', time) AS thirtymins,
                        CASE WHEN value >= 35 THEN 1.0 WHEN value < 35 THEN 0.0 END::DOUBLE AS harmful,
                        CASE WHEN value <= 12 THEN 1.0 WHEN value > 12 THEN 0.0 END::DOUBLE AS not_harmful
                      FROM points""",
    "hex_pairs": inside_sql("points", "hexagon_edges", "id", "hexagon_id", "lng", "lat"),
    "block_pairs": inside_sql("points", "block_edges", "id", "geoid10", "lng", "lat"),
    "area_pairs": inside_sql("points", "area_edges", "id", "pri_neigh", "lng", "lat"),
    **GRID,
    "grid_pairs": """SELECT p.id, min(x.id) AS big_hexagon_id FROM points p JOIN hexes x
               ON abs(p.lng - x.x) <= x.w / 2 AND abs(p.lat - x.y) <= x.d / 2 - abs(p.lng - x.x) / sqrt(3)
             GROUP BY p.id""",
    "tagged": """SELECT f.*, b.geoid10, a.pri_neigh, h.hexagon_id, g.big_hexagon_id FROM flag_points f
                 LEFT JOIN block_pairs b USING (id) LEFT JOIN area_pairs a USING (id)
                 LEFT JOIN hex_pairs h USING (id) LEFT JOIN grid_pairs g USING (id)""",
    "cells": """SELECT hexagon_id, thirtymins, thirtymins::DATE AS "Daily", harmful, not_harmful,
                       max(value) AS max, sum(value) AS sum, count(*) AS count FROM tagged
                WHERE hexagon_id IS NOT NULL AND harmful IS NOT NULL AND not_harmful IS NOT NULL GROUP BY ALL""",
}
SITE_DAYS = {
    "epa_flags": EPA_FLAGS,
    "epa_daily": EPA_DAILY,
    **PA_CLEAN,
    "pa_daily": f"""SELECT "Daily", address, lat, lon, max(v) AS max, coalesce(sum(v), 0)::DOUBLE AS sum,
                           count(*) AS count, {shares()} FROM pa_clean GROUP BY ALL""",
}
ALL_TABLES = "points hexagon_edges block_edges area_edges epa_raw pa_typed"


def rollup_sql(source: str, keys: str = '"Daily"') -> str:
    return f"""SELECT {keys}, max(max) AS max, sum(sum) AS sum, sum(count)::BIGINT AS count,
                      sum(sum) / sum(count) AS mean, {shares('count')} FROM {source} GROUP BY ALL"""


def cell_rollup_sql(source: str) -> str:
    return f"""SELECT a.*, c.harmful_hex, c.not_harmful_hex, c.hex_ct FROM ({rollup_sql(source)}) a
        JOIN (SELECT "Daily", avg((round(m, 9) >= 35)::INTEGER) AS harmful_hex,
                     avg((round(m, 9) <= 12)::INTEGER) AS not_harmful_hex, count(*) AS hex_ct
              FROM (SELECT "Daily", hexagon_id, sum(sum) / sum(count) AS m FROM {source} GROUP BY ALL)
              GROUP BY "Daily") c USING ("Daily")"""


def job_sql(body: str, **more: str) -> str:
    return with_tables(ALL_TABLES, body, **HEX, **SITE_DAYS, **more)


# ---- networks ------------------------------------------------------------------

_BOX = """{lon} - 1.0::DOUBLE / 60 AS xmin, {lat} - 1.0::DOUBLE / 60 AS ymin,
          {lon} + 1.0::DOUBLE / 60 AS xmax, {lat} + 1.0::DOUBLE / 60 AS ymax"""
_BOX_DIGITS = {c: 9 for c in ("xmin", "ymin", "xmax", "ymax")}


@register(
    "epa_process",
    with_tables(
        "epa_raw",
        f"SELECT *, {_BOX.format(lon='longitude', lat='latitude')} FROM ({EPA_PROFILE})",
    ),
    {
        "sample_measurement|median": 9,
        "sample_measurement|mean": 9,
        "sample_measurement|sum": 6,
        **_BOX_DIGITS,
    },
)
def epa_process(spark, d):
    _, sites = S.process_epa(D.epa_raw(spark, d))
    return sites.select("*", "envelope.*").drop("envelope")


@register(
    "epa_readings",
    with_tables("epa_raw", "SELECT * EXCLUDE (event_id) FROM epa_raw"),
)
def epa_readings(spark, d):
    return S.process_epa(D.epa_raw(spark, d))[0]


@register(
    "purpleair_process",
    with_tables(
        "pa_typed",
        f"""SELECT s.*, p.std_address, {_BOX.format(lon='lon', lat='lat')} FROM sites s
            LEFT JOIN (SELECT DISTINCT address AS std_address, "ParentID" FROM sites WHERE "ID" = "ParentID") p
              ON p."ParentID" = s."ParentID" """,
        sites=PA_PROFILE,
    ),
    {f"{S.PM}|median": 9, f"{S.PM}|mean": 9, f"{S.PM}|sum": 6, **_BOX_DIGITS},
)
def purpleair_process(spark, d):
    sites = S.purpleair_sites(S.purpleair_typed(D.purpleair_raw(spark, d)))
    return sites.select("*", "envelope.*").drop("envelope")


_GRAIN_SQL = """SELECT '{g}' AS grain, {key}::VARCHAR AS cell, thirtymins, harmful, not_harmful,
    median(value) AS median, avg(value) AS mean, max(value) AS max, min(value) AS min, sum(value) AS sum,
    count(*) AS count FROM tagged
    WHERE {key} IS NOT NULL AND harmful IS NOT NULL AND not_harmful IS NOT NULL GROUP BY ALL"""


@register(
    "aq_process",
    with_tables(
        "points hexagon_edges block_edges area_edges",
        " UNION ALL ".join(_GRAIN_SQL.format(g=g, key=k) for g, k in community.GRAINS.items()),
        **HEX,
    ),
    "median, mean, sum",
)
def aq_process(spark, d):
    """All four half-hour tables, one below the other."""
    return community.process_points_long(tag_points(spark, d))


# ---- comparison ----------------------------------------------------------------


@register(
    "daily_by_source",
    job_sql(
        f"""SELECT 'EPA' AS source, *, NULL::DOUBLE AS harmful_hex, NULL::DOUBLE AS not_harmful_hex,
                   NULL::BIGINT AS hex_ct FROM ({rollup_sql('epa_daily')})
            UNION ALL BY NAME SELECT 'PurpleAir' AS source, * FROM ({rollup_sql('pa_daily')})
            UNION ALL BY NAME SELECT 'AirQuality' AS source, * FROM ({cell_rollup_sql('cells')})"""
    ),
    "sum, mean, harmful, not_harmful, harmful_hex, not_harmful_hex",
)
def daily_by_source(spark, d):
    names = ("EPA", "PurpleAir", "AirQuality")
    daily = compare.daily_by_source(
        epa_daily(spark, d), purpleair_daily(spark, d), by_hexagon(spark, d)
    )
    marked = [df.withColumn("source", F.lit(n)) for n, df in zip(names, daily)]
    return (
        marked[0]
        .unionByName(marked[1])
        .unionByName(marked[2], allowMissingColumns=True)
    )


@register(
    "reading_weighted_share",
    job_sql(
        """SELECT "Daily", sum(harmful * count) / sum(count) FILTER (WHERE harmful IS NOT NULL)
                  AS harmful_readings FROM epa_daily GROUP BY ALL"""
    ),
    "harmful_readings",
)
def reading_weighted_share(spark, d):
    return A.weighted_share(epa_daily(spark, d), ["Daily"], "harmful", "harmful_readings")


def station_squares(spark, d):
    sites = D.epa_raw(spark, d).select("value_represented", "longitude", "latitude").distinct()
    return sites.withColumn("box", G.site_box(F.col("longitude"), F.col("latitude")))


STATIONS = """SELECT DISTINCT row_number() OVER (ORDER BY value_represented, longitude, latitude) AS site_number,
                {box} FROM (SELECT DISTINCT value_represented, longitude, latitude FROM epa_raw)""".format(
    box=_BOX.format(lon="longitude", lat="latitude")
)
NEAR = {
    **TOUCH_SQL,
    "boxes": STATIONS,
    "near_cells": "SELECT * FROM cells WHERE hexagon_id IN (SELECT pid FROM touching)",
}


def _near_sql(boxes: str) -> str:
    """Cells of the hexagons that touch a network's squares."""
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in {**TOUCH_SQL, "boxes": boxes}.items())
    return f"SELECT * FROM (WITH {ctes} SELECT * FROM cells WHERE hexagon_id IN (SELECT pid FROM touching)) AS near"


_ADDRESSES = f"""SELECT address AS site_number, {_BOX.format(lon='lon', lat='lat')}
                 FROM (SELECT DISTINCT address, lon, lat FROM pa_typed)"""


def near_networks(spark, d, hexagons):
    """Hexagons near the sensors of the two networks."""
    return {
        "EPA": compare.hexagons_near(station_squares(spark, d), ["value_represented", "longitude", "latitude"], hexagons),
        "PA": compare.hexagons_near(address_squares(spark, d), ["address", "lon", "lat"], hexagons),
    }


@register(
    "near_sensor_daily",
    job_sql(f"SELECT * FROM ({cell_rollup_sql('near_cells')})", **NEAR),
    "sum, mean, harmful, not_harmful, harmful_hex, not_harmful_hex",
)
def near_sensor_daily(spark, d):
    known = D.sensors(spark, d)
    hexagons = D.hexagons(spark, d, known)
    return compare.near_sensor_daily(
        by_hexagon(spark, d, known=known, hexagons=hexagons),
        station_squares(spark, d),
        ["value_represented", "longitude", "latitude"],
        hexagons,
    )


def address_squares(spark, d):
    # Distinct before the texts are parsed, of which each channel repeats one.
    places = D.purpleair_raw(spark, d).select("address", "location").distinct()
    lat, lon = parse_point(F.col("location"))
    sites = places.select("address", lon.alias("lon"), lat.alias("lat")).distinct()
    return sites.withColumn("box", G.site_box(F.col("lon"), F.col("lat")))


@register(
    "near_sensor_daily_purpleair",
    job_sql(
        f"SELECT * FROM ({cell_rollup_sql('near_cells')})",
        **{
            **NEAR,
            "boxes": """SELECT address AS site_number, {box}
                        FROM (SELECT DISTINCT address, lon, lat FROM pa_typed)""".format(
                box=_BOX.format(lon="lon", lat="lat")
            ),
        },
    ),
    "sum, mean, harmful, not_harmful, harmful_hex, not_harmful_hex",
)
def near_sensor_daily_purpleair(spark, d):
    known = D.sensors(spark, d)
    hexagons = D.hexagons(spark, d, known)
    return compare.near_sensor_daily(
        by_hexagon(spark, d, known=known, hexagons=hexagons),
        address_squares(spark, d),
        ["address", "lon", "lat"],
        hexagons,
    )


@register(
    "scoped_daily_rollup",
    job_sql(
        f"""SELECT 'all' AS scope, * FROM ({cell_rollup_sql('cells')})
            UNION ALL SELECT 'EPA', * FROM ({cell_rollup_sql('near_epa')})
            UNION ALL SELECT 'PA', * FROM ({cell_rollup_sql('near_pa')})""",
        near_epa=_near_sql(STATIONS),
        near_pa=_near_sql(_ADDRESSES),
    ),
    "sum, mean, harmful, not_harmful, harmful_hex, not_harmful_hex",
)
def scoped_daily_rollup(spark, d):
    """All hexagons and those near each network, rolled up together."""
    known = D.sensors(spark, d)
    hexagons = D.hexagons(spark, d, known)
    cells = by_hexagon(spark, d, known=known, hexagons=hexagons)
    return compare.scoped_daily_rollup(cells, near_networks(spark, d, hexagons))


def comparison(spark, d, aq=AQ_SUPPORT, epa=EPA_SUPPORT, pa=PA_SUPPORT):
    """Daily comparison of the three networks over all hexagons."""
    e, p, a = compare.daily_by_source(
        epa_daily(spark, d), purpleair_daily(spark, d), by_hexagon(spark, d)
    )
    return compare.daily_comparison(a, e, p, aq, epa, pa)


def _side(prefix: str) -> str:
    return ", ".join(
        f'{prefix.lower()}.{c} AS "{prefix}_{c}"'
        for c in ("max", "sum", "count", "mean", "harmful", "not_harmful")
    )


def comparison_sql(cells: str = "cells", aq: int = 80, hexes: int = 5, epa: int = 62, pa: int = 90) -> str:
    return f"""
    SELECT aq."Daily", {_side('AQ')}, {_side('EPA')}, {_side('PA')}, aq.harmful_hex, aq.not_harmful_hex,
           aq.hex_ct, year(aq."Daily")::INTEGER AS "Year"
    FROM (SELECT * FROM ({cell_rollup_sql(cells)}) WHERE count >= {aq} AND hex_ct >= {hexes}) aq
    LEFT JOIN (SELECT * FROM ({rollup_sql('epa_daily')}) WHERE count >= {epa}) epa ON epa."Daily" = aq."Daily"
    LEFT JOIN (SELECT * FROM ({rollup_sql('pa_daily')}) WHERE count >= {pa}) pa ON pa."Daily" = aq."Daily" """


COMPARISON = comparison_sql()
COMPARISON_DIGITS = {
    **{f"{p}_{c}": 9 for p in ("AQ", "EPA", "PA") for c in ("mean", "harmful", "not_harmful")},
    **{f"{p}_sum": 6 for p in ("AQ", "EPA", "PA")},
    "harmful_hex": 9,
    "not_harmful_hex": 9,
}


@register("daily_comparison", job_sql(COMPARISON), COMPARISON_DIGITS)
def daily_comparison(spark, d):
    return comparison(spark, d)


def map_layers(spark, d):
    sites = D.epa_raw(spark, d).select("value_represented", "site_number", "longitude", "latitude").distinct()
    squares = sites.select(
        "value_represented",
        F.col("site_number").cast("string").alias("site_number"),
        G.site_box(F.col("longitude"), F.col("latitude")).alias("box"),
    )
    cells = materialize(by_hexagon(spark, d))
    e, p = materialize(epa_daily(spark, d)), materialize(purpleair_daily(spark, d))
    common = compare.daily_comparison(
        compare.hexagon_daily_rollup(cells),
        compare.site_daily_rollup(e),
        compare.site_daily_rollup(p),
        AQ_SUPPORT,
        EPA_SUPPORT,
        PA_SUPPORT,
    )
    return compare.daily_map_layers(e, squares, p, cells, D.hexagons(spark, d), common)


def stacked_layers(layers, extra=()):
    """The layers below each other with the columns that identify a shape."""
    shape = {
        "epa": F.concat_ws("/", F.col("EPA Station"), F.col("site_number"), F.round("box.xmin", 6).cast("string")),
        "purpleair": F.concat_ws("/", F.col("lat").cast("string"), F.col("lon").cast("string")),
        "hexagons": F.concat_ws("/", F.col("id").cast("string"), F.size(F.col("rings")[0]).cast("string")),
    }
    out = None
    for name, df in layers.items():
        part = df.select(
            "Source", "Date", *extra, F.col("`Average PM2.5`"), "count", shape[name].alias("shape")
        )
        out = part if out is None else out.unionByName(part)
    return out


LAYERS = {
    "common": f"""SELECT "Daily" AS "Date" FROM ({cell_rollup_sql('cells')}) WHERE count >= 80 AND hex_ct >= 5""",
    "epa_sites": """SELECT DISTINCT value_represented, site_number, round(longitude - 1.0::DOUBLE / 60, 6) AS x
                    FROM epa_raw""",
    "layers": """SELECT 'EPA' AS "Source", e."Daily" AS "Date", round_even(round(e.mean, 9), 2) AS "Average PM2.5",
                        e.count, concat_ws('/', e.value_represented, s.site_number, s.x) AS shape
                 FROM epa_daily e LEFT JOIN epa_sites s USING (value_represented) WHERE e.mean IS NOT NULL
                 UNION ALL
                 SELECT 'PurpleAir', "Daily", round_even(round(sum(sum) / sum(count), 9), 2), sum(count)::BIGINT,
                        lat || '/' || lon FROM pa_daily GROUP BY "Daily", lat, lon
                 UNION ALL
                 SELECT 'AirQuality', "Daily", round_even(round(sum(sum) / sum(count), 9), 2), sum(count)::BIGINT,
                        hexagon_id || '/7' FROM cells GROUP BY "Daily", hexagon_id""",
}


@register(
    "daily_map_layers",
    job_sql('SELECT * FROM layers WHERE "Date" IN (SELECT "Date" FROM common)', **LAYERS),
)
def daily_map_layers(spark, d):
    return stacked_layers(map_layers(spark, d))


@register(
    "monthly_map_frames",
    job_sql(
        """SELECT "Source", strftime("Date", '%Y-%m-%d') AS "Date", year("Date")::INTEGER AS year,
                  month("Date")::INTEGER AS month, "Average PM2.5", count, shape FROM shown
           WHERE (year("Date"), month("Date")) IN
             (SELECT (y, m) FROM (SELECT DISTINCT year("Date") AS y, month("Date") AS m, "Source" FROM shown)
              GROUP BY y, m HAVING count(*) = 3)""",
        **LAYERS,
        shown='SELECT * FROM layers WHERE "Date" IN (SELECT "Date" FROM common)',
    ),
)
def monthly_map_frames(spark, d):
    frames = compare.monthly_map_frames(map_layers(spark, d))
    return stacked_layers(frames, ["year", "month"])


# ---- neighborhoods -------------------------------------------------------------

HOODS = """SELECT pri_neigh, thirtymins, geoid10, round_even(lat, 5) AS lat_r, round_even(lng, 5) AS lng_r,
                  coalesce(sum(value), 0)::DOUBLE AS sum, count(*) AS count, year(thirtymins)::INTEGER AS "Yearly",
                  date_trunc('month', thirtymins)::DATE AS "MonthYear", hour(thirtymins)::INTEGER AS "Hourly"
           FROM tagged WHERE pri_neigh IS NOT NULL AND geoid10 IS NOT NULL GROUP BY ALL"""


def hood_sql(body: str, **more: str) -> str:
    return with_tables(
        "points hexagon_edges block_edges area_edges", body, **HEX, hoods=HOODS, **more
    )


_LEVEL = """CASE WHEN m > -0.1 AND m <= 6 THEN '0-6' WHEN m > 6 AND m <= 12 THEN '6-12'
   WHEN m > 12 AND m <= 22 THEN '12-22' WHEN m > 22 AND m <= 35 THEN '22-35' WHEN m > 35 AND m <= 1000 THEN '35+' END"""


@register(
    "neighborhood_points",
    hood_sql(
        """SELECT * FROM real UNION SELECT * REPLACE ('All' AS "Hourly", 'All' AS "Daily", 'All' AS "Monthly",
             'All' AS "MonthYear", 'All' AS "Yearly") FROM real""",
        spots="""SELECT pri_neigh, thirtymins, lat_r, lng_r, round(sum(sum) / sum(count), 9) AS m FROM hoods
                 GROUP BY ALL""",
        real=f"""SELECT pri_neigh, lat_r, lng_r, {_LEVEL} AS "Average PM2.5 Group", hour(thirtymins)::VARCHAR AS "Hourly",
                   strftime(thirtymins, '%Y-%m-%d') AS "Daily", month(thirtymins)::VARCHAR AS "Monthly",
                   strftime(date_trunc('month', thirtymins), '%Y-%m-%d') AS "MonthYear",
                   year(thirtymins)::VARCHAR AS "Yearly", thirtymins::VARCHAR AS time, round_even(m, 1) AS mean
                 FROM spots""",
    ),
)
def neighborhood_points(spark, d):
    return neighborhood.neighborhood_points(neighborhood_rows(spark, d))


@register(
    "neighborhood_blocks",
    hood_sql(
        """SELECT b.pri_neigh, b.geoid10, CASE WHEN mean >= q THEN 'Top 10%' ELSE 'Low 90%' END AS "Average PM2.5 Group",
                  b."MonthYear"::VARCHAR AS "MonthYear", round_even(mean, 2) AS mean, count, 7 AS corners
           FROM b JOIN (SELECT pri_neigh, "MonthYear", quantile_cont(mean, 0.9) AS q FROM b GROUP BY ALL)
             USING (pri_neigh, "MonthYear")""",
        b="""SELECT pri_neigh, "MonthYear", geoid10, round(sum(sum) / sum(count), 9) AS mean, sum(count)::BIGINT AS count
             FROM hoods GROUP BY ALL""",
    ),
)
def neighborhood_blocks(spark, d):
    known = D.sensors(spark, d)
    blocks = D.blocks(spark, d, known)
    rows = neighborhood_rows(spark, d, blocks=blocks, known=known)
    shown = neighborhood.neighborhood_blocks(rows, "MonthYear", blocks)
    return shown.withColumn("corners", F.size(F.col("rings")[0])).drop("rings")


@register(
    "neighborhood_series",
    hood_sql(
        """SELECT pri_neigh, "Hourly", sum(sum) AS sum, sum(count)::BIGINT AS count,
                  sum(sum) / sum(count) AS "PM2.5" FROM hoods GROUP BY ALL"""
    ),
    {"sum": 6, "PM2.5": 9},
)
def neighborhood_series(spark, d):
    return neighborhood.neighborhood_series(neighborhood_rows(spark, d), "Hourly")


# ---- dimensions, refresh, reports ----------------------------------------------


@register(
    "geo_dimension_build",
    with_tables(
        "block_edges area_edges hexagon_edges",
        f"""SELECT 'blocks' AS name, pid AS key, left(pid, 12) AS geo_12, area_3857_km2, min(x1) AS xmin, max(y1) AS ymax
              FROM block_edges JOIN ({area_sql('block_edges')}) USING (pid) GROUP BY ALL
            UNION ALL SELECT 'neighborhoods', pid, NULL, area_3857_km2, min(x1), max(y1)
              FROM area_edges JOIN ({area_sql('area_edges')}) USING (pid) GROUP BY ALL
            UNION ALL SELECT 'hexagons', pid::VARCHAR, NULL, NULL, min(x1), max(y1) FROM hexagon_edges GROUP BY pid
            UNION ALL SELECT 'big_hexagons', id::VARCHAR, NULL, NULL, x - w / 2, y + d / 2 FROM hexes""",
        **GRID,
    ),
    {"xmin": 9, "ymax": 9, "area_3857_km2": 4},
)
def geo_dimension_build(spark, d):
    """Every block row comes twice; wholly equal rows are one."""
    known = D.sensors(spark, d)
    blocks = D.blocks(spark, d, known)
    built = geodims.build_dimensions(
        blocks.union(blocks), D.neighborhoods(spark, d, known), D.hexagons(spark, d, known)
    )
    keys = {"blocks": "geoid10", "neighborhoods": "pri_neigh", "hexagons": "id", "big_hexagons": "id"}
    out = None
    for name, df in built.items():
        columns = [
            F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c)
            for c, kind in (("geo_12", "string"), ("area_3857_km2", "double"))
        ]
        part = df.select(
            F.lit(name).alias("name"), F.col(keys[name]).cast("string").alias("key"), *columns, "bbox.xmin", "bbox.ymax"
        )
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "refresh_watermark",
    with_tables(
        "flagged",
        """SELECT least(max("Daily") FILTER (WHERE source = 'EPA'), max(thirtymins) FILTER (WHERE source = 'AQ')::DATE,
                        greatest(max(thirtymins) FILTER (WHERE source = 'PA'), TIMESTAMP '2016-01-01')::DATE)
                  AS last_updated FROM flagged""",
    ),
)
def refresh_watermark(spark, d):
    f = D.flagged(spark, d)
    current = {"epa": (f.where("source = 'EPA'"), "Daily"), "aq": (f.where("source = 'AQ'"), "thirtymins")}
    return refresh.refresh_watermark(current, f.where("source = 'PA'"))


def _daily_table(rows):
    return A.summarize(rows, ["Daily"], ["sensor_id"], value="pm")


NETWORKS = ("AQ", "EPA", "PA")
REFRESHED = with_tables(
    "flagged",
    """SELECT source AS network, "Daily", sensor_id, median(pm) AS median, avg(pm) AS mean, max(pm) AS max,
              coalesce(sum(pm), 0)::DOUBLE AS sum, count(*) AS count
       FROM flagged WHERE "Daily" < DATE '2024-01-29' GROUP BY ALL""",
)


def _loader(spark, d):
    f = D.flagged(spark, d)

    def load(start: dt.date, end: dt.date):
        window = f.where((F.col("Daily") >= F.lit(start)) & (F.col("Daily") < F.lit(end)))
        return {s: _daily_table(window.where(F.col("source") == s)) for s in NETWORKS}

    return load


def _at_once(work, names):
    """``work`` of each name, a few at a time."""
    with ThreadPoolExecutor(refresh.AT_ONCE) as pool:
        return dict(zip(names, pool.map(work, names)))


def _stacked(done):
    marked = [done[s].withColumn("network", F.lit(s)) for s in NETWORKS]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


@register("incremental_refresh", REFRESHED, "median, mean, sum")
def incremental_refresh(spark, d):
    """Load up to mid January, then refresh twice; the second run changes nothing.

    The first load stops inside its last day, as real pulls do: that day is
    dropped and loaded again in full.
    """
    f, load = D.flagged(spark, d), _loader(spark, d)
    partial = f.where(F.col("time") < F.lit("2024-01-15 10:00:00").cast("timestamp_ntz"))
    first = {s: _daily_table(partial.where(F.col("source") == s)) for s in NETWORKS}
    # Written: a refresh reads its tables for their latest day and again for their rows.
    current = {s: (df, "Daily") for s, df in _at_once(lambda s: materialize(first[s], f"first-{s}"), NETWORKS).items()}
    for run in range(2):
        out = new_path(spark, f"refresh-{run}")
        done = refresh.incremental_refresh(spark, current, load, out, dt.date(2024, 1, 29))
        current = {s: (done[s], "Daily") for s in NETWORKS}
    return _stacked(done)


@register(
    "incremental_refresh_partitions",
    REFRESHED,
    "median, mean, sum",
)
def incremental_refresh_partitions(spark, d):
    """The same on tables partitioned by day, of which only the loaded days are written."""
    f, load = D.flagged(spark, d), _loader(spark, d)
    partial = f.where(F.col("time") < F.lit("2024-01-15 10:00:00").cast("timestamp_ntz"))
    paths = {s: new_path(spark, f"days-{s}") for s in NETWORKS}
    first = {s: _daily_table(partial.where(F.col("source") == s)) for s in NETWORKS}
    _at_once(lambda s: tables.write_partitioned(first[s], paths[s], "Daily"), NETWORKS)
    for _ in range(2):
        done = refresh.refresh_partitions(spark, paths, load, dt.date(2024, 1, 29))
    return _stacked(done)


# ---- refresh of the networks' own tables ----------------------------------------

_CUT, _MARK, _LAST, _END = "2024-01-15 10:00:00", "2024-01-15", "2024-01-28", "2024-01-29"


def _pa_days(start: str, end: str, days: tuple[str, str]) -> str:
    """Days of the self-reported table as one load makes them: outliers are those of its own window."""
    typed = f"""SELECT * FROM ({D.CTES['pa_typed']}) WHERE time >= TIMESTAMP '{start}' AND time < TIMESTAMP '{end}'"""
    body = f"""SELECT 'purpleair_daily' AS name, address AS key, "Daily"::VARCHAR AS time, coalesce(sum(v), 0)::DOUBLE AS sum,
               count(*) AS count FROM pa_clean WHERE "Daily" >= DATE '{days[0]}' AND "Daily" < DATE '{days[1]}' GROUP BY ALL"""
    return f"SELECT * FROM ({with_tables('pa_typed', body, pa_typed=typed, **PA_CLEAN)}) AS loaded"


_LAST_DAY = f"time >= TIMESTAMP '{_LAST}' AND time < TIMESTAMP '{_END}'"
NETWORK_TABLES = with_tables(
    "points hexagon_edges block_edges area_edges epa_raw pa_typed",
    " UNION ALL ".join(
        [
            f"""SELECT 'aq_by_{g}' AS name, {k}::VARCHAR AS key, thirtymins::VARCHAR AS time,
                       coalesce(sum(value), 0)::DOUBLE AS sum, count(*) AS count FROM tagged
                WHERE {k} IS NOT NULL AND harmful IS NOT NULL AND not_harmful IS NOT NULL AND time < TIMESTAMP '{_END}'
                GROUP BY {k}, thirtymins, harmful, not_harmful"""
            for g, k in community.GRAINS.items()
        ]
        + [
            f"""SELECT 'neighborhoods', pri_neigh || ' ' || geoid10 || ' ' || lat_r || ' ' || lng_r, thirtymins::VARCHAR, sum, count
                FROM hoods WHERE thirtymins < TIMESTAMP '{_END}'""",
            f"""SELECT 'epa_daily', value_represented, "Daily"::VARCHAR, coalesce(sum(sample_measurement), 0)::DOUBLE, count(*)
                FROM epa_flags WHERE "Daily" < DATE '{_END}' GROUP BY "Daily", value_represented, latitude, longitude""",
            f"""SELECT 'epa_sites', site_number, NULL, coalesce(sum(sample_measurement), 0)::DOUBLE, count(*) FROM epa_flags
                WHERE "Daily" = DATE '{_LAST}' GROUP BY site_number""",
            f"""SELECT 'purpleair_sites', "ID", NULL, coalesce(sum("PM2.5 (ATM)"), 0)::DOUBLE, count(*) FROM pa_typed
                WHERE {_LAST_DAY} GROUP BY "ID" """,
            _pa_days("2024-01-01", _CUT, ("2024-01-01", _MARK)),
            _pa_days(_MARK, _END, (_MARK, _LAST)),
            _pa_days(_LAST, _END, (_LAST, _END)),
        ]
    ),
    **HEX,
    epa_flags=EPA_FLAGS,
    hoods=HOODS,
)


@register("network_refresh", NETWORK_TABLES, {"sum": 6})
def network_refresh(spark, d):
    """The nine tables of the networks: a first load that ends inside a day, then two refreshes.

    The second refresh loads the last day once more, which changes nothing but what
    depends on the load itself: the outliers of that day, and the site profiles.
    """
    known = D.sensors(spark, d)
    areas = D.neighborhoods(spark, d, known)
    layers = D.blocks(spark, d, known), areas, D.hexagons(spark, d, known), HexGrid.over(extent(areas))

    def raw(start: str, end: str):
        """Records from ``start`` to before ``end``, compared as text as the feeds give them."""
        e, p, c = D.epa_raw(spark, d), D.purpleair_raw(spark, d), D.community_points(spark, d)
        at = {"e": F.concat_ws(" ", "date_local", "time_local"), "p": F.translate("created_at", "TZ", " "), "c": F.translate("time", "T", " ")}
        e, p, c = (df.where((at[k] >= start) & (at[k] < end)) for k, df in (("e", e), ("p", p), ("c", c)))
        tagged = materialize(community.tag_points(c, *layers))
        return refresh.network_tables(e, p, tagged, FIRST_DAY)

    made = raw("2024-01-01", _CUT)
    # Written: a refresh reads its tables for their latest time and again for their rows.
    made |= _at_once(lambda n: materialize(made[n], f"first-{n}"), list(refresh.TIMES))
    for run in range(2):
        current = {n: (made[n], time) for n, time in refresh.TIMES.items()}
        made = refresh.incremental_refresh(
            spark,
            current,
            lambda start, end: raw(str(start), str(end)),
            new_path(spark, f"networks-{run}"),
            dt.date.fromisoformat(_END),
            neighborhoods="neighborhoods",
            profiles={n: made[n] for n in refresh.PROFILES},
        )
    hood = F.concat_ws(" ", "pri_neigh", "geoid10", F.col("lat_r").cast("string"), F.col("lng_r").cast("string"))
    keys = {
        "epa_daily": F.col("value_represented"),
        "purpleair_daily": F.col("address"),
        "epa_sites": F.col("site_number"),
        "purpleair_sites": F.col("ID"),
        "neighborhoods": hood,
        **{f"aq_by_{g}": F.col(k).cast("string") for g, k in community.GRAINS.items()},
    }
    values = {"epa_sites": "sample_measurement|", "purpleair_sites": f"{S.PM}|"}
    out = None
    for name, df in made.items():
        time = F.col(refresh.TIMES[name]).cast("string") if name in refresh.TIMES else F.lit(None).cast("string")
        sums = [F.col(f"`{values.get(name, '')}{c}`").alias(c) for c in ("sum", "count")]
        part = df.select(F.lit(name).alias("name"), keys[name].alias("key"), time.alias("time"), *sums)
        out = part if out is None else out.union(part)
    return out


def _dashboard_sql(name: str, networks: tuple[str, ...]) -> list[str]:
    """Row count and total of each dataset made from one comparison table."""
    flag = "TRUE" if name != "aq" else "FALSE"
    full = f"(SELECT * FROM {name}_days t WHERE NOT ({' OR '.join(f't.{c} IS NULL' for c in _COMPARED)}))"

    def over(column: str, fn: str) -> list[str]:
        return [f'{fn}("{n}_{column}")' for n in networks]

    def bounds(names, column="mean") -> tuple[str, str]:
        low, high = (", ".join(f'{fn}("{n}_{column}")' for n in names) for fn in ("min", "max"))
        return f"least({low})", f"greatest({high})"

    out = []
    for kind, column, upper in (("mean", "mean", None), ("harmful", "harmful", "0.1"), ("low", "not_harmful", None)):
        low, high = bounds(networks, column)
        total = f"{' + '.join(over(column, 'sum'))} + count(*) * ({low} + {upper or high})"
        out.append(f"SELECT {flag} AS two_miles, '{name}/heatmap_{kind}' AS dataset, count(*) AS n, {total} AS total FROM {full}")
    sums = " + ".join(over("mean", "sum"))
    ends = " + ".join([*over("mean", "min"), *over("mean", "max")])
    size = len(networks)
    out.append(f"SELECT {flag}, '{name}/timeseries', {size} * count(*), {sums} FROM {full}")
    for box in ("boxplot", "all_years_boxplot"):
        out.append(f"SELECT {flag}, '{name}/{box}', {size}, {ends} FROM {full}")
    for n in networks:
        if n != "AQ":
            low, high = bounds(("AQ", n))
            for scatter in ("scatter", "all_years_scatter"):
                out.append(f"SELECT {flag}, '{name}/{scatter}_{n}', 1, {low} + {high} FROM {full}")
    return out


_COMPARED = [f'"{p}_{c}"' for p in ("AQ", "EPA", "PA") for c in ("max", "sum", "count", "mean", "harmful", "not_harmful")]
_COMPARED += ["harmful_hex", "not_harmful_hex"]
DASHBOARD = with_tables(
    ALL_TABLES,
    " UNION ALL ".join(
        [
            *_dashboard_sql("aq", ("EPA", "AQ", "PA")),
            *_dashboard_sql("near_epa", ("EPA", "AQ")),
            *_dashboard_sql("near_pa", ("PA", "AQ")),
            *[
                sql
                for flag in ("TRUE", "FALSE")
                for sql in (
                    f"""SELECT {flag}, 'neighborhood_summary', count(*), sum(s) + sum(c)
                        FROM (SELECT sum(sum) AS s, sum(count) AS c FROM hoods GROUP BY pri_neigh)""",
                    f"""SELECT {flag}, 'map/hexagons', count(*), sum(sum) FROM cells
                        WHERE year("Daily") = 2024 AND month("Daily") = 1""",
                    f"""SELECT {flag}, 'neighborhood/series', count(DISTINCT "MonthYear"), sum(sum) FROM hoods
                        WHERE pri_neigh = (SELECT min(pid) FROM area_edges)""",
                )
            ],
        ]
    ),
    **HEX,
    **SITE_DAYS,
    hoods=HOODS,
    near_epa_cells=_near_sql(STATIONS),
    near_pa_cells=_near_sql(_ADDRESSES),
    aq_days=comparison_sql("cells", 1, 1, 1, 1),
    near_epa_days=comparison_sql("near_epa_cells", 1, 1, 1, 1),
    near_pa_days=comparison_sql("near_pa_cells", 1, 1, 1, 1),
)
#: What is added up of each kind of dataset.
_SHOWN = {
    "heatmap": lambda c: c not in ("Daily", "year"),
    "timeseries": lambda c: c == "value",
    "scatter": lambda c: c.startswith("axis_"),
    "boxplot": lambda c: c in (next(iter(QUARTILES)), list(QUARTILES)[-1]),
    "neighborhood_summary": lambda c: c in ("sum", "count"),
    "map/": lambda c: c == "sum",
    "neighborhood/": lambda c: c == "sum",
}


@register("report_dataset", DASHBOARD, {"total": 5})
def report_dataset(spark, d):
    """Everything the dashboard shows for one selection: rows and total of each dataset."""
    tagged = tagged_points(spark, d)
    cells, e = materialize(by_hexagon(spark, d, tagged)), materialize(epa_daily(spark, d))
    p = materialize(purpleair_daily(spark, d))
    hexagons = D.hexagons(spark, d)
    scoped = materialize(compare.scoped_daily_rollup(cells, near_networks(spark, d, hexagons)))
    near = {scope: scoped.where(F.col("scope") == scope).drop("scope") for scope in ("all", "EPA", "PA")}
    support = ({"count": 1, "hex_ct": 1}, {"count": 1}, {"count": 1})
    days = compare.site_daily_rollup(e), compare.site_daily_rollup(p)
    combined = {
        name: materialize(compare.daily_comparison(near[scope], *days, *support))
        for name, scope in (("aq", "all"), ("near_epa", "EPA"), ("near_pa", "PA"))
    }
    rows = materialize(neighborhood_rows(spark, d, tagged))
    summary = A.neighborhood_summary(calendar_features(rows, "thirtymins"), "pri_neigh", "Daily")
    first = D.neighborhoods(spark, d).agg(F.min("pri_neigh")).first()[0]
    out = None
    for two_miles in (False, True):
        chosen = reports.report_dataset(
            combined,
            year=2024,
            month=1,
            neighborhood=first,
            two_miles=two_miles,
            months=(1,),
            after_year=2017,
            maps={"hexagons": calendar_features(cells, "thirtymins").withColumns({"year": F.col("Yearly"), "month": F.col("Monthly")})},
            areas={"series": neighborhood.neighborhood_series(rows, "MonthYear")},
            summary=summary,
        )
        for name, df in chosen.items():
            shown = next(f for kind, f in _SHOWN.items() if kind in name)
            value = sum((F.coalesce(F.sum(c).cast("double"), F.lit(0.0)) for c in df.columns if shown(c)), F.lit(0.0))
            part = df.agg(F.count(F.lit(1)).alias("n"), value.alias("total")).select(
                F.lit(two_miles).alias("two_miles"), F.lit(name).alias("dataset"), "n", "total"
            )
            out = part if out is None else out.unionByName(part)
    return out
