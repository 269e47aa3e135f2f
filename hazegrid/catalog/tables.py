"""Sensor tables derived from the driver's ``events``, in Spark and in SQL.

Coordinates are made in whole 1/100000 degrees and divided once by a double, so
both engines get the same doubles. Sensors stand on a grid of 15 columns; each
has a block (an L, so some of its points are outside) and a small hexagon. Six
sensors make a neighborhood of two parts: a rectangle with a hole that overlaps its
right neighbor, so some points match twice, and in that hole an island with a hole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.calendar import calendar_features, floor_half_hour
from hazegrid.functions.levels import level_flags
from hazegrid.operators.joins import join_lookup
from hazegrid.session import materialize

# Corner lists in 1/100000 degrees from the shape's origin.
BLOCK = [(0, 0), (1000, 0), (1000, 400), (500, 400), (500, 800), (0, 800), (0, 0)]
HEXAGON = [(250, 0), (750, 0), (1000, 400), (750, 800), (250, 800), (0, 400), (250, 0)]
AREA = [(0, 0), (6300, 0), (6300, 8000), (0, 8000), (0, 0)]
AREA_HOLE = [(1000, 300), (1000, 700), (2500, 700), (2500, 300), (1000, 300)]
ISLAND = [(2050, 350), (2400, 350), (2400, 650), (2050, 650), (2050, 350)]
ISLAND_HOLE = [(2150, 400), (2150, 500), (2300, 500), (2300, 400), (2150, 400)]
AREA_RINGS = (AREA, AREA_HOLE, ISLAND, ISLAND_HOLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _deg(units: Column) -> Column:
    return units.cast("double") / F.lit(100000.0)


def _x0(sensor: Column) -> Column:
    return F.lit(-8790000) + 2000 * (sensor % 15)


def _y0(sensor: Column) -> Column:
    return F.lit(4165000) + 4000 * F.floor(sensor / 15)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, time, sensor_id, source, value, pm (value with gaps), lon, lat."""
    return readings_of(table(spark, sf_dir, "events"))


def readings_of(e: DataFrame) -> DataFrame:
    """The same from an ``events`` table or stream."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    source = (
        F.when(kind.isin("view", "click"), "AQ").when(kind == "purchase", "EPA").otherwise("PA")
    )
    return e.select(
        "event_id",
        F.col("ts").alias("time"),
        user.alias("sensor_id"),
        source.alias("source"),
        "value",
        F.when(event % 11 != 0, F.col("value")).alias("pm"),
        _deg(_x0(user) + 50 * (event % 20) + 13).alias("lon"),
        _deg(_y0(user) + 50 * (event % 16) + 17).alias("lat"),
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with calendar columns, half hour and level flags of ``pm``."""
    r = calendar_features(readings(spark, sf_dir), "time")
    r = r.withColumn("thirtymins", floor_half_hour(F.col("time")))
    return level_flags(r, "pm", "pm")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors of the events, written: shapes made from them are read several times."""
    events = table(spark, sf_dir, "events")
    return materialize(events.select(F.col("user_id").alias("sensor_id")).distinct())


# The grid position of sensor_id, as in ``_x0`` and ``_y0``.
_SENSOR_AT = ("(-8790000 + 2000 * (sensor_id % 15))", "(4165000 + 4000 * floor(sensor_id / 15))")


def _rings(at: tuple[str, str], *outlines: list[tuple[int, int]]) -> Column:
    def ring(corners):
        points = (
            f"struct(double({at[0]} + {dx}) / 100000D AS x, double({at[1]} + {dy}) / 100000D AS y)"
            for dx, dy in corners
        )
        return f"array({', '.join(points)})"

    return F.expr(f"array({', '.join(map(ring, outlines))})").alias("rings")


def blocks(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    s = F.col("sensor_id")
    return (known or sensors(spark, sf_dir)).select(
        F.concat(F.lit("17031"), F.lpad(s.cast("string"), 10, "0")).alias("geoid10"),
        _rings(_SENSOR_AT, BLOCK),
    )


def hexagons(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    known = known or sensors(spark, sf_dir)
    return known.select(F.col("sensor_id").alias("id"), _rings(_SENSOR_AT, HEXAGON))


def neighborhoods(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    s = F.col("sensor_id")
    places = (
        (known or sensors(spark, sf_dir))
        .select(
            F.floor((s % 15) / 3).alias("nx"), F.floor(F.floor(s / 15) / 2).alias("ny")
        )
        .distinct()
        .withColumn("n_nationkey", ((F.col("nx") + 5 * F.col("ny")) % 25).cast("int"))
    )
    named = join_lookup(
        places, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]
    )
    at = ("(-8790000 + 6000 * nx)", "(4165000 + 8000 * ny)")
    return named.select(
        F.concat_ws("-", F.col("n_name"), F.col("ny").cast("string")).alias("pri_neigh"),
        _rings(at, *AREA_RINGS),
        F.expr("array(false, true, false, true)").alias("holes"),
    )


def _units_text(units: Column) -> Column:
    """Whole units as decimal degrees text."""
    size = F.abs(units)
    return F.concat(
        F.when(units < 0, "-").otherwise(""),
        F.floor(size / 100000).cast("string"),
        F.lit("."),
        F.lpad((size % 100000).cast("string"), 5, "0"),
    )


def epa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulatory records: two sites per station."""
    s = F.col("sensor_id")
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "EPA")
        .select(
            "event_id",
            s.alias("site_number"),
            F.lit(88101).alias("parameter_code"),
            _deg(_y0(s) + 417).alias("latitude"),
            _deg(_x0(s) + 513).alias("longitude"),
            F.col("pm").alias("sample_measurement"),
            F.when(s % 2 == 0, "1 HOUR").otherwise("24 HOUR").alias("sample_duration"),
            F.concat(F.lit("EVERY "), (s % 4).cast("string")).alias("sample_frequency"),
            F.concat(F.lit("METHOD "), (s % 3).cast("string")).alias("method_type"),
            F.concat(F.lit("Station "), F.floor(s / 2).cast("string")).alias("value_represented"),
            F.date_format("time", "yyyy-MM-dd").alias("date_local"),
            F.date_format("time", "HH:mm").alias("time_local"),
        )
    )


def purpleair_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-reported channels: two per sensor, the second a child of the first."""
    s, channel = F.col("sensor_id"), F.col("event_id") % 2
    device = s * 10 + channel
    suffix = F.when(channel == 1, " B").otherwise("")
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "PA")
        .select(
            "event_id",
            device.alias("ID"),
            F.when(channel == 1, s * 10).cast("double").alias("ParentID"),
            F.concat(F.lit("Addr "), s.cast("string"), suffix).alias("address"),
            F.concat(
                F.lit("("), _units_text(_y0(s) + 417), F.lit(", "), _units_text(_x0(s) + 513), F.lit(")")
            ).alias("location"),
            F.when(channel == 1, F.lit(None))
            .when(s % 5 == 0, "inside")
            .otherwise("outside")
            .alias("device_loc"),
            F.concat(F.lit("Monitor_"), device.cast("string")).alias("name"),
            (device + 1000).alias("primaryID"),
            F.lit("2017-01-01T00:00:00Z").alias("sensor_created_at"),
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            F.col("pm").alias("PM2.5 (ATM)"),
            (F.col("value") * 2).alias("PM2.5 (CF=1)"),
        )
    )


def community_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile sensor points with ISO text times."""
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "AQ")
        .select(
            F.col("event_id").alias("id"),
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
            F.col("pm").alias("value"),
            "lat",
            F.col("lon").alias("lng"),
        )
    )


# ---- the same tables in SQL ------------------------------------------------


def _values(corners: list[tuple[int, int]], ring: int) -> str:
    sides = zip(corners[:-1], corners[1:])
    return ", ".join(f"({ring}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in sides)


def _deg_sql(expr: str) -> str:
    return f"(({expr})::DOUBLE / 100000.0::DOUBLE)"


_X0 = "(-8790000 + 2000 * (sensor_id % 15))"
_Y0 = "(4165000 + 4000 * (sensor_id // 15))"


def _edges_sql(base: str, key: str, x0: str, y0: str, sides: str) -> str:
    return (
        f"SELECT {key} AS pid, ring, {_deg_sql(x0 + ' + dx1')} AS x1, "
        f"{_deg_sql(y0 + ' + dy1')} AS y1, {_deg_sql(x0 + ' + dx2')} AS x2, "
        f"{_deg_sql(y0 + ' + dy2')} AS y2 "
        f"FROM {base}, (VALUES {sides}) AS v(ring, dx1, dy1, dx2, dy2)"
    )


CTES = {
    "readings": f"""
        SELECT event_id, ts AS time, user_id AS sensor_id,
               CASE WHEN event_type IN ('view', 'click') THEN 'AQ'
                    WHEN event_type = 'purchase' THEN 'EPA' ELSE 'PA' END AS source,
               value, CASE WHEN event_id % 11 <> 0 THEN value END AS pm,
               {_deg_sql(_X0.replace('sensor_id', 'user_id') + ' + 50 * (event_id % 20) + 13')} AS lon,
               {_deg_sql(_Y0.replace('sensor_id', 'user_id') + ' + 50 * (event_id % 16) + 17')} AS lat
        FROM events""",
    "flagged": """
        SELECT *, hour(time)::INTEGER AS "Hourly", time::DATE AS "Daily",
               month(time)::INTEGER AS "Monthly", date_trunc('month', time)::DATE AS "MonthYear",
               year(time)::INTEGER AS "Yearly",
               time_bucket(INTERVAL '30 minutes', time) AS thirtymins,
               CASE WHEN pm >= 35 THEN 1.0 WHEN pm < 35 THEN 0.0 END::DOUBLE AS harmful,
               CASE WHEN pm <= 12 THEN 1.0 WHEN pm > 12 THEN 0.0 END::DOUBLE AS not_harmful
        FROM readings""",
    "sensors": "SELECT DISTINCT user_id AS sensor_id FROM events",
    "block_edges": _edges_sql(
        "sensors", "'17031' || lpad(sensor_id::VARCHAR, 10, '0')", _X0, _Y0, _values(BLOCK, 0)
    ),
    "hexagon_edges": _edges_sql("sensors", "sensor_id", _X0, _Y0, _values(HEXAGON, 0)),
    "places": """
        SELECT p.nx, p.ny, n.n_name || '-' || p.ny AS pri_neigh
        FROM (SELECT DISTINCT (sensor_id % 15) // 3 AS nx, (sensor_id // 15) // 2 AS ny
              FROM sensors) p
        LEFT JOIN nation n ON n.n_nationkey = (p.nx + 5 * p.ny) % 25""",
    "area_edges": _edges_sql(
        "places",
        "pri_neigh",
        "(-8790000 + 6000 * nx)",
        "(4165000 + 8000 * ny)",
        ", ".join(_values(r, i) for i, r in enumerate(AREA_RINGS)),
    ),
    "epa_raw": f"""
        SELECT event_id, sensor_id::VARCHAR AS site_number, '88101' AS parameter_code,
               {_deg_sql(_Y0 + ' + 417')} AS latitude, {_deg_sql(_X0 + ' + 513')} AS longitude,
               pm AS sample_measurement,
               CASE WHEN sensor_id % 2 = 0 THEN '1 HOUR' ELSE '24 HOUR' END AS sample_duration,
               'EVERY ' || (sensor_id % 4) AS sample_frequency,
               'METHOD ' || (sensor_id % 3) AS method_type,
               'Station ' || (sensor_id // 2) AS value_represented,
               strftime(time, '%Y-%m-%d') || ' ' || strftime(time, '%H:%M') AS "Full Date"
        FROM readings WHERE source = 'EPA'""",
    "pa_typed": f"""
        SELECT event_id, (sensor_id * 10 + event_id % 2)::VARCHAR AS "ID",
               (sensor_id * 10)::VARCHAR AS "ParentID",
               'Addr ' || sensor_id || CASE WHEN event_id % 2 = 1 THEN ' B' ELSE '' END AS address,
               {_deg_sql(_Y0 + ' + 417')} AS lat, {_deg_sql(_X0 + ' + 513')} AS lon,
               CASE WHEN event_id % 2 = 1 THEN 'missing' WHEN sensor_id % 5 = 0 THEN 'inside'
                    ELSE 'outside' END AS device_loc,
               'Monitor_' || (sensor_id * 10 + event_id % 2) AS name,
               (sensor_id * 10 + event_id % 2 + 1000)::VARCHAR AS "primaryID",
               '2017-01-01T00:00:00Z' AS sensor_created_at,
               strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
               time, pm AS "PM2.5 (ATM)", value * 2 AS "PM2.5 (CF=1)"
        FROM readings WHERE source = 'PA'""",
    "points": """
        SELECT event_id AS id, date_trunc('second', time) AS time, pm AS value, lat, lon AS lng
        FROM readings WHERE source = 'AQ'""",
}

NEEDS = {
    "flagged": ["readings"],
    "block_edges": ["sensors"],
    "hexagon_edges": ["sensors"],
    "places": ["sensors"],
    "area_edges": ["places"],
    "epa_raw": ["readings"],
    "pa_typed": ["readings"],
    "points": ["readings"],
}


def with_tables(names: str, body: str, **more: str) -> str:
    """SQL with the named tables (and their inputs) in front, then ``more``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        done.setdefault(name, CTES[name])

    for name in names.split():
        add(name)
    done.update(more)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in done.items())
    return f"WITH {ctes}\n{body}" if done else body


def inside_sql(points: str, edges: str, key: str, pid: str, x: str = "lon", y: str = "lat") -> str:
    """Pairs (key, pid) of points inside or on a polygon, by ray casting."""
    return f"""
        SELECT p.{key}, e.pid AS {pid}
        FROM {points} p
        JOIN (SELECT pid, min(least(x1, x2)) AS bx0, max(greatest(x1, x2)) AS bx1,
                     min(least(y1, y2)) AS by0, max(greatest(y1, y2)) AS by1
              FROM {edges} GROUP BY pid) b
          ON p.{x} BETWEEN b.bx0 AND b.bx1 AND p.{y} BETWEEN b.by0 AND b.by1
        JOIN {edges} e ON e.pid = b.pid
        GROUP BY p.{key}, e.pid
        HAVING count(*) FILTER (WHERE (e.y1 > p.{y}) <> (e.y2 > p.{y})
                 AND p.{x} < e.x1 + (e.x2 - e.x1) * (p.{y} - e.y1) / nullif(e.y2 - e.y1, 0)) % 2 = 1
            OR bool_or((e.x2 - e.x1) * (p.{y} - e.y1) = (e.y2 - e.y1) * (p.{x} - e.x1)
                 AND p.{x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                 AND p.{y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"""
