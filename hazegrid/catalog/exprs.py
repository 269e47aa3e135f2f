"""Date, level and geometry expressions over tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.functions import calendar as C
from hazegrid.functions import geometry as G
from hazegrid.functions import levels as L
from hazegrid.operators import aggregates as A
from hazegrid.operators.spatial import HexGrid, extent
from hazegrid.plans.geodims import big_hexagons


@register(
    "calendar_features",
    with_tables("flagged", 'SELECT event_id, time, "Hourly", "Daily", "Monthly", "MonthYear", "Yearly" FROM flagged'),
)
def calendar_features(spark, d):
    return C.calendar_features(D.readings(spark, d).select("event_id", "time"), "time")


@register(
    "calendar_features_orders",
    """SELECT o_orderkey, o_orderdate, month(o_orderdate)::INTEGER AS "Monthly",
              date_trunc('month', o_orderdate)::DATE AS "MonthYear", year(o_orderdate)::INTEGER AS "Yearly"
       FROM orders""",
)
def calendar_features_orders(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return C.calendar_features(o, "o_orderdate", hourly=False, daily=False)


@register("floor_30min", with_tables("flagged", "SELECT event_id, thirtymins FROM flagged"))
def floor_30min(spark, d):
    r = D.readings(spark, d)
    return r.select("event_id", C.floor_half_hour(F.col("time")).alias("thirtymins"))


@register("level_flags", with_tables("flagged", "SELECT event_id, pm, harmful, not_harmful FROM flagged"))
def level_flags(spark, d):
    return L.level_flags(D.readings(spark, d).select("event_id", "pm"), "pm", "pm")


@register(
    "share_categories",
    """SELECT event_id, harmful, low,
         CASE WHEN harmful >= 0 AND harmful < 0.01 THEN '0-1' WHEN harmful > 0.01 AND harmful < 0.03 THEN '1-3'
              WHEN harmful >= 0.03 AND harmful < 0.06 THEN '3-6' WHEN harmful >= 0.06 AND harmful < 0.14 THEN '6-14'
              WHEN harmful >= 0.14 THEN '14+' ELSE '' END AS harmful_cat,
         CASE WHEN low >= 0 AND low < 0.02 THEN '0-2' WHEN low > 0.02 AND low < 0.1 THEN '2-10'
              WHEN low >= 0.1 AND low < 0.9 THEN '10-90' WHEN low >= 0.9 AND low < 0.98 THEN '90-98'
              WHEN low >= 0.98 THEN '98+' ELSE '' END AS low_cat
       FROM (SELECT event_id,
               CASE WHEN event_id % 11 <> 0 THEN (event_id % 20)::DOUBLE / 100::DOUBLE END AS harmful,
               (event_id % 101)::DOUBLE / 100::DOUBLE AS low FROM events)""",
)
def share_categories(spark, d):
    e, event = D.table(spark, d, "events"), F.col("event_id")
    shares = e.select(
        "event_id",
        F.when(event % 11 != 0, (event % 20).cast("double") / 100.0).alias("harmful"),
        ((event % 101).cast("double") / 100.0).alias("low"),
    )
    return L.share_categories(shares, "harmful", "low")


@register(
    "level_bins",
    with_tables(
        "readings",
        """SELECT event_id, pm, CASE WHEN pm > -0.1 AND pm <= 6 THEN '0-6' WHEN pm > 6 AND pm <= 12 THEN '6-12'
             WHEN pm > 12 AND pm <= 22 THEN '12-22' WHEN pm > 22 AND pm <= 35 THEN '22-35'
             WHEN pm > 35 AND pm <= 1000 THEN '35+' END AS level FROM readings""",
    ),
)
def level_bins(spark, d):
    r = D.readings(spark, d).select("event_id", "pm")
    return r.withColumn("level", L.level_bins(F.col("pm")))


@register(
    "site_envelope",
    with_tables(
        "epa_raw",
        """SELECT DISTINCT site_number, longitude - 1.0::DOUBLE / 60 AS xmin, latitude - 1.0::DOUBLE / 60 AS ymin,
                  longitude + 1.0::DOUBLE / 60 AS xmax, latitude + 1.0::DOUBLE / 60 AS ymax FROM epa_raw""",
    ),
    "xmin, ymin, xmax, ymax",
)
def site_envelope(spark, d):
    sites = D.epa_raw(spark, d).select(F.col("site_number").cast("string").alias("site_number"), "longitude", "latitude")
    boxed = sites.distinct().withColumn("box", G.site_box(F.col("longitude"), F.col("latitude")))
    return boxed.select("site_number", "box.*")


_MERC_X = "radians({x}) * 6378137"
_MERC_Y = "ln(tan(pi() / 4 + radians({y}) / 2)) * 6378137"


def area_sql(edges: str) -> str:
    """Area of each ``pid``; odd rings are holes."""
    x1, x2, y1, y2 = (m.format(x=f"x{i}", y=f"y{i}") for m in (_MERC_X, _MERC_Y) for i in (1, 2))
    return f"""SELECT pid, sum(CASE WHEN ring % 2 = 0 THEN a ELSE -a END) AS area_3857_km2 FROM
        (SELECT pid, ring, abs(sum(mx1 * my2 - mx2 * my1)) / 2 / 1e6 AS a FROM
          (SELECT pid, ring, {x1} AS mx1, {x2} AS mx2, {y1} AS my1, {y2} AS my2 FROM {edges}) GROUP BY pid, ring)
        GROUP BY pid"""


def centroid_sql(edges: str) -> str:
    """Centre of each ``pid``; odd rings are holes, whichever way round they are drawn."""
    return f"""SELECT pid, ox + sum(s * mx) / (3 * sum(s * a)) AS x, oy + sum(s * my) / (3 * sum(s * a)) AS y FROM
        (SELECT pid, ox, oy, (CASE WHEN ring % 2 = 0 THEN 1 ELSE -1 END) * sign(sum(c)) AS s, sum(c) AS a,
                sum((x1 + x2) * c) AS mx, sum((y1 + y2) * c) AS my FROM
          (SELECT *, x1 * y2 - x2 * y1 AS c FROM
            (SELECT e.pid, e.ring, o.ox, o.oy, x1 - ox AS x1, x2 - ox AS x2, y1 - oy AS y1, y2 - oy AS y2 FROM {edges} e
             JOIN (SELECT pid, min(x1) AS ox, min(y1) AS oy FROM {edges} GROUP BY pid) o ON o.pid = e.pid))
         GROUP BY pid, ring, ox, oy) GROUP BY pid, ox, oy"""


@register(
    "polygon_area_km2",
    with_tables("area_edges", f"SELECT pid AS pri_neigh, area_3857_km2 FROM ({area_sql('area_edges')})"),
    {"area_3857_km2": 4},
)
def polygon_area_km2(spark, d):
    """Shapes of two parts, each with a hole."""
    areas = D.neighborhoods(spark, d)
    return areas.select("pri_neigh", G.area_3857_km2(F.col("rings"), F.col("holes")).alias("area_3857_km2"))


_CENTROIDS = centroid_sql("block_edges")


@register(
    "polygon_centroid",
    with_tables(
        "block_edges area_edges",
        f"SELECT pid AS id, x, y FROM ({_CENTROIDS}) UNION ALL SELECT pid, x, y FROM ({centroid_sql('area_edges')})",
    ),
    {"x": 8, "y": 8},
)
def polygon_centroid(spark, d):
    b = D.blocks(spark, d).select(F.col("geoid10").alias("id"), G.centroid(F.col("rings")).alias("c"))
    a = D.neighborhoods(spark, d)
    a = a.select(F.col("pri_neigh").alias("id"), G.centroid(F.col("rings"), F.col("holes")).alias("c"))
    return b.union(a).select("id", "c.x", "c.y")


@register(
    "map_center_of_shapes",
    with_tables(
        "block_edges",
        f"""SELECT round_even(median(y), 4) AS lat_center, round_even(median(x), 4) AS lon_center
            FROM ({_CENTROIDS})""",
    ),
)
def map_center_of_shapes(spark, d):
    return A.map_center_of_shapes(D.blocks(spark, d))


HAVERSINE = (
    "2 * 6371000 * atan2(sqrt(sin(radians({y2} - {y1}) / 2) ** 2 + cos(radians({y1})) * cos(radians({y2}))"
    " * sin(radians({x2} - {x1}) / 2) ** 2), sqrt(1 - (sin(radians({y2} - {y1}) / 2) ** 2"
    " + cos(radians({y1})) * cos(radians({y2})) * sin(radians({x2} - {x1}) / 2) ** 2)))"
)


def miles_sql(meters: str) -> str:
    return f"round_even(round_even({meters}, 0) * 0.00062137::DOUBLE, 0)::BIGINT"


SIN60 = math.sin(math.pi / 3)
GRID = {
    "box": "SELECT min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM area_edges",
    "grid": f"""SELECT xmin, ymax, n_cols, n_rows, (xmax - xmin) / n_cols AS w, (xmax - xmin) / n_cols / {SIN60!r}::DOUBLE AS d
        FROM (SELECT *, floor({miles_sql(HAVERSINE.format(x1='xmin', y1='ymin', x2='xmax', y2='ymin'))}
                              / {SIN60!r}::DOUBLE)::BIGINT + 1 AS n_cols,
                     {miles_sql(HAVERSINE.format(x1='xmin', y1='ymin', x2='xmin', y2='ymax'))} + 1 AS n_rows FROM box)""",
    "hexes": """SELECT r * n_cols + c AS id, r AS row, c AS col, xmin + c * w + (r % 2) * w / 2 AS x,
                       ymax - r * d * 0.75::DOUBLE AS y, w, d
        FROM grid, LATERAL (SELECT unnest(range(0, n_rows)) AS r), LATERAL (SELECT unnest(range(0, n_cols)) AS c)""",
}


@register(
    "extent",
    with_tables("area_edges", "SELECT * FROM box", box=GRID["box"]),
)
def extent_query(spark, d):
    return extent(D.neighborhoods(spark, d))


@register(
    "hex_grid",
    with_tables(
        "area_edges",
        """SELECT id, row, col, x, y, y + d / 2 AS top, x - w / 2 AS left_x, y - d / 4 AS left_y FROM hexes""",
        **GRID,
    ),
    "x, y, top, left_x, left_y",
)
def hex_grid(spark, d):
    _, hexes = big_hexagons(D.neighborhoods(spark, d))
    ring = F.col("rings")[0]
    return hexes.select(
        "id",
        "row",
        "col",
        "x",
        "y",
        ring[0]["y"].alias("top"),
        ring[2]["x"].alias("left_x"),
        ring[2]["y"].alias("left_y"),
    )


@register(
    "hex_assign",
    with_tables(
        "area_edges readings",
        """SELECT r.event_id, min(h.id) AS big_hexagon_id FROM readings r LEFT JOIN hexes h
             ON abs(r.lon - h.x) <= h.w / 2 AND abs(r.lat - h.y) <= h.d / 2 - abs(r.lon - h.x) / sqrt(3)
           GROUP BY r.event_id""",
        **GRID,
    ),
)
def hex_assign(spark, d):
    grid = HexGrid.over(extent(D.neighborhoods(spark, d)))
    r = D.readings(spark, d)
    return r.select("event_id", grid.id_at("lon", "lat").alias("big_hexagon_id"))
