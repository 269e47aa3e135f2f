"""Attribute and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.exprs import GRID, HAVERSINE, miles_sql
from hazegrid.catalog.tables import inside_sql, with_tables
from hazegrid.functions import geometry as G
from hazegrid.operators import joins as J
from hazegrid.operators import spatial as P
from hazegrid.plans.sites import purpleair_typed


@register(
    "left_join_site_attrs",
    """SELECT c_custkey, c_name, c_nationkey, n_nationkey, n_name AS n_name
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def left_join_site_attrs(spark, d):
    customers = D.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = D.table(spark, d, "nation").select("n_nationkey", "n_name")
    return J.left_join_sites(customers, nations, "c_nationkey", "n_nationkey")


@register(
    "left_join_suffixes",
    with_tables(
        "readings",
        """SELECT r.event_id, r.sensor_id AS sensor_id_left, r.lat AS lat_left, s.sensor_id AS sensor_id_right,
                  s.lat AS lat_right, s.n
           FROM (SELECT event_id, lat, CASE WHEN event_id % 7 <> 0 THEN sensor_id + event_id % 2 * 100000 END AS sensor_id
                 FROM readings) r
           LEFT JOIN (SELECT sensor_id, min(lat) AS lat, count(*) AS n FROM readings GROUP BY sensor_id) s
             ON s.sensor_id = r.sensor_id""",
    ),
)
def left_join_suffixes(spark, d):
    """Some readings have no sensor, some a foreign one."""
    r = D.readings(spark, d)
    sites = r.groupBy("sensor_id").agg(F.min("lat").alias("lat"), F.count(F.lit(1)).alias("n"))
    foreign = F.expr("if(event_id % 7 <> 0, sensor_id + event_id % 2 * 100000, NULL)")
    return J.left_join_sites(r.select("event_id", foreign.alias("sensor_id"), "lat"), sites, "sensor_id", "sensor_id")


@register(
    "salted_join",
    """SELECT l_orderkey, l_linenumber, s_name
       FROM (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN l_suppkey END AS k FROM lineitem)
       LEFT JOIN supplier ON k = s_suppkey""",
)
def salted_join(spark, d):
    """The way taken when the lookup is too large to broadcast; some rows have no key."""
    key = F.expr("if(l_orderkey % 5 <> 0, l_suppkey, NULL)").alias("l_suppkey")
    li = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key)
    sup = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return J.join_lookup(li, sup, ["l_suppkey"], broadcast=False).drop("l_suppkey")


FAMILY = """SELECT DISTINCT "ID", "ParentID", address FROM pa_typed"""


@register(
    "self_join_parent_name",
    with_tables(
        "pa_typed",
        """SELECT s."ID", s."ParentID", s.address, p.address AS std_address FROM family s
           LEFT JOIN (SELECT DISTINCT "ParentID", address FROM family WHERE "ID" = "ParentID") p
             ON p."ParentID" = s."ParentID" """,
        family=FAMILY,
    ),
)
def self_join_parent_name(spark, d):
    family = purpleair_typed(D.purpleair_raw(spark, d)).select("ID", "ParentID", "address").distinct()
    return J.attach_parent_name(family, "ID", "ParentID", "address", "std_address")


def _daily(spark, d, source):
    day = F.to_date("time").alias("Daily")
    return (
        D.readings(spark, d)
        .where(F.col("source") == source)
        .groupBy(day)
        .agg(F.sum("pm").alias("sum"), F.count(F.lit(1)).alias("count"), F.max("pm").alias("max"))
    )


@register(
    "three_source_left_join",
    with_tables(
        "readings",
        """SELECT a."Daily", a.sum AS "AQ_sum", a.count AS "AQ_count", a.max AS "AQ_max", a.hex_ct,
                  e.sum AS "EPA_sum", e.count AS "EPA_count", e.max AS "EPA_max",
                  p.sum AS "PA_sum", p.count AS "PA_count", p.max AS "PA_max"
           FROM (SELECT "Daily", sum(pm) AS sum, count(*) AS count, max(pm) AS max,
                        count(DISTINCT sensor_id) AS hex_ct FROM days WHERE source = 'AQ' GROUP BY "Daily") a
           LEFT JOIN (SELECT "Daily", sum(pm) AS sum, count(*) AS count, max(pm) AS max FROM days
                      WHERE source = 'EPA' GROUP BY "Daily" HAVING count(*) > 60) e USING ("Daily")
           LEFT JOIN (SELECT "Daily", sum(pm) AS sum, count(*) AS count, max(pm) AS max FROM days
                      WHERE source = 'PA' GROUP BY "Daily") p USING ("Daily")""",
        days='SELECT *, time::DATE AS "Daily" FROM readings',
    ),
    {"AQ_sum": 6, "EPA_sum": 6, "PA_sum": 6},
)
def three_source_left_join(spark, d):
    day = F.to_date("time").alias("Daily")
    cells = D.readings(spark, d).where("source = 'AQ'").groupBy(day).agg(F.count_distinct("sensor_id").alias("hex_ct"))
    aq = _daily(spark, d, "AQ").join(cells, "Daily")
    return J.combine_sources(aq, _daily(spark, d, "EPA").where("count > 60"), _daily(spark, d, "PA"))


@register(
    "semi_join_ids",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)""",
)
def semi_join_ids(spark, d):
    li = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    small = D.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return J.semi_join(li, small, ["l_partkey"])


@register(
    "semi_join_common_days",
    with_tables(
        "readings",
        """SELECT event_id, time::DATE AS "Date" FROM readings WHERE time::DATE IN
           (SELECT time::DATE FROM readings WHERE source = 'EPA' GROUP BY ALL HAVING count(*) > 64)""",
    ),
)
def semi_join_common_days(spark, d):
    r = D.readings(spark, d).select("event_id", F.to_date("time").alias("Date"))
    common = _daily(spark, d, "EPA").where("count > 64").select(F.col("Daily").alias("Date"))
    return J.semi_join(r, common, ["Date"])


@register(
    "join_geometry",
    with_tables(
        "readings hexagon_edges",
        """SELECT a.id, a.mean, b.xmin, b.ymin, b.xmax, b.ymax, b.corners
           FROM (SELECT sensor_id AS id, avg(pm) AS mean FROM readings GROUP BY ALL) a
           JOIN (SELECT pid, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax,
                        count(*)::INTEGER AS corners FROM hexagon_edges GROUP BY pid) b ON b.pid = a.id""",
    ),
    {"mean": 9},
)
def join_geometry(spark, d):
    means = D.readings(spark, d).groupBy(F.col("sensor_id").alias("id")).agg(F.avg("pm").alias("mean"))
    shaped = J.join_lookup(means, D.hexagons(spark, d), ["id"], "inner")
    return shaped.withColumn("box", G.bbox(F.col("rings"))).select(
        "id", "mean", "box.*", F.size(G.edges(F.col("rings"))).alias("corners")
    )


@register(
    "point_in_polygon_join",
    with_tables(
        "readings area_edges",
        """SELECT r.event_id, m.pri_neigh FROM readings r LEFT JOIN m ON m.event_id = r.event_id""",
        m=inside_sql("readings", "area_edges", "event_id", "pri_neigh"),
    ),
)
def point_in_polygon_join(spark, d):
    r = D.readings(spark, d).select("event_id", "lon", "lat")
    return P.locate(r, D.neighborhoods(spark, d), ["pri_neigh"]).select("event_id", "pri_neigh")


@register(
    "geotag_layers",
    with_tables(
        "readings block_edges area_edges hexagon_edges",
        """SELECT r.event_id, b.geoid10, a.pri_neigh, h.hexagon_id, g.big_hexagon_id
           FROM readings r LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)
           LEFT JOIN h USING (event_id) LEFT JOIN g USING (event_id)""",
        b=inside_sql("readings", "block_edges", "event_id", "geoid10"),
        a=inside_sql("readings", "area_edges", "event_id", "pri_neigh"),
        h=inside_sql("readings", "hexagon_edges", "event_id", "hexagon_id"),
        **GRID,
        g="""SELECT r.event_id, min(x.id) AS big_hexagon_id FROM readings r JOIN hexes x
               ON abs(r.lon - x.x) <= x.w / 2 AND abs(r.lat - x.y) <= x.d / 2 - abs(r.lon - x.x) / sqrt(3)
             GROUP BY r.event_id""",
    ),
)
def geotag_layers(spark, d):
    known = D.sensors(spark, d)
    areas = D.neighborhoods(spark, d, known)
    layers = [
        (D.blocks(spark, d, known), {"geoid10": "geoid10"}),
        (areas, {"pri_neigh": "pri_neigh"}),
        (D.hexagons(spark, d, known), {"id": "hexagon_id"}),
    ]
    r = D.readings(spark, d).select("event_id", "lon", "lat")
    return P.geotag(r, layers, P.HexGrid.over(P.extent(areas))).drop("lon", "lat")


def station_boxes(spark, d):
    sites = D.epa_raw(spark, d).select("site_number", "longitude", "latitude").distinct()
    box = G.site_box(F.col("longitude"), F.col("latitude"))
    return sites.select("site_number", box.alias("box"))


# Convex shapes meet if no side of either one separates them.
BOXES_SQL = """SELECT DISTINCT site_number::BIGINT AS site_number, longitude - 1.0::DOUBLE / 60 AS xmin,
                 latitude - 1.0::DOUBLE / 60 AS ymin, longitude + 1.0::DOUBLE / 60 AS xmax,
                 latitude + 1.0::DOUBLE / 60 AS ymax FROM epa_raw"""
TOUCH_SQL = {
    "boxes": BOXES_SQL,
    "hexbox": """SELECT pid, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1
                 FROM hexagon_edges GROUP BY pid""",
    "near": """SELECT * FROM boxes JOIN hexbox ON bx0 <= xmax AND bx1 >= xmin AND by0 <= ymax AND by1 >= ymin""",
    "apart": """SELECT DISTINCT n.site_number, n.pid FROM near n
        JOIN hexagon_edges e ON e.pid = n.pid
        JOIN (SELECT s.pid, s.x1 AS sx, s.y1 AS sy, s.x2 AS tx, s.y2 AS ty,
                     max((p.x1 - s.x1) * (s.y1 - s.y2) + (p.y1 - s.y1) * (s.x2 - s.x1)) AS top,
                     min((p.x1 - s.x1) * (s.y1 - s.y2) + (p.y1 - s.y1) * (s.x2 - s.x1)) AS bottom
              FROM hexagon_edges s JOIN hexagon_edges p ON p.pid = s.pid GROUP BY ALL) h
          ON h.pid = e.pid AND h.sx = e.x1 AND h.sy = e.y1
        WHERE greatest((xmin - sx) * (sy - ty) + (ymin - sy) * (tx - sx), (xmax - sx) * (sy - ty) + (ymin - sy) * (tx - sx),
                       (xmin - sx) * (sy - ty) + (ymax - sy) * (tx - sx), (xmax - sx) * (sy - ty) + (ymax - sy) * (tx - sx)) < bottom - 1e-12
           OR least((xmin - sx) * (sy - ty) + (ymin - sy) * (tx - sx), (xmax - sx) * (sy - ty) + (ymin - sy) * (tx - sx),
                    (xmin - sx) * (sy - ty) + (ymax - sy) * (tx - sx), (xmax - sx) * (sy - ty) + (ymax - sy) * (tx - sx)) > top + 1e-12""",
    "touching": "SELECT site_number, pid FROM near EXCEPT SELECT site_number, pid FROM apart",
}


@register(
    "polygon_intersects_join",
    with_tables(
        "epa_raw hexagon_edges",
        """SELECT b.site_number, t.pid AS id FROM boxes b LEFT JOIN touching t ON t.site_number = b.site_number""",
        **TOUCH_SQL,
    ),
)
def polygon_intersects_join(spark, d):
    joined = P.polygons_touching(
        station_boxes(spark, d), ["site_number"], D.hexagons(spark, d), ["id"]
    )
    return joined.select("site_number", "id")


@register(
    "within_radius_join",
    with_tables(
        "readings",
        f"""SELECT * , {miles_sql('meters')} AS miles FROM
            (SELECT a.sensor_id, b.sensor_id AS sensor_id_2,
                    {HAVERSINE.format(x1='a.lon', y1='a.lat', x2='b.lon', y2='b.lat')} AS meters
             FROM sites a JOIN sites b ON b.sensor_id <> a.sensor_id
               AND abs(a.lat - b.lat) < 0.1 AND abs(a.lon - b.lon) < 0.1)
            WHERE meters <= 5000""",
        sites="SELECT sensor_id, min(lon) AS lon, min(lat) AS lat FROM readings GROUP BY sensor_id",
    ),
    {"meters": 4},
)
def within_radius_join(spark, d):
    sites = D.readings(spark, d).groupBy("sensor_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    pairs = P.within_radius(sites, sites, 5000.0)
    return pairs.where("sensor_id <> sensor_id_2").select("sensor_id", "sensor_id_2", "meters", "miles")
