"""Planar geometry on rings held as arrays, in native expressions.

A shape is ``rings ARRAY<ARRAY<STRUCT<x, y>>>`` with its box
``bbox STRUCT<xmin, ymin, xmax, ymax>``. An odd number of crossings is inside, so the
order of the rings does not matter there. Measures have to know which rings are
holes: ``holes ARRAY<BOOLEAN>``, one flag a ring. Without it the shape has one part,
whose first ring is the outline. Parts of a shape do not overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii (m), the mile factor, the sensor radius in degrees.
EARTH_RADIUS_M = 6371000
MERCATOR_RADIUS_M = 6378137
MILES_PER_M = 0.00062137
SITE_RADIUS_DEG = 1 / 60


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# ---- reading and writing shapes -------------------------------------------


def parts_from_wkt(wkt: Column) -> Column:
    """Parts of a POLYGON or MULTIPOLYGON text, each an array of rings."""
    # Between two parts, two closing brackets, a comma and two opening ones.
    texts = F.split(wkt, r"(?<=\)\s{0,9}\))\s*,\s*(?=\(\s*\()")

    def point(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return xy(parts[0], parts[1])

    def rings(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
        return F.transform(found, lambda t: F.transform(F.split(t, ","), point))

    return F.transform(texts, rings)


def rings_from_wkt(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON text."""
    return F.flatten(parts_from_wkt(wkt))


def parts_from_geojson(kind: Column, coordinates: Column) -> Column:
    """Parts from a GeoJSON type and its coordinates kept as JSON text."""
    single = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    several = F.from_json(coordinates, "array<array<array<array<double>>>>")
    parts = F.when(kind == "MultiPolygon", several).otherwise(single)
    return F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: xy(p[0], p[1]))))


def holes_of(parts: Column) -> Column:
    """One flag for each ring of all parts: every ring but a part's first is a hole."""
    return F.flatten(F.transform(parts, lambda rings: F.transform(rings, lambda r, i: i > 0)))


def rings_to_wkt(rings: Column, holes: Column | None = None) -> Column:
    """POLYGON text, or MULTIPOLYGON with ``holes``; numbers as Spark prints doubles."""
    ring = lambda r: F.concat(
        F.lit("("),
        F.array_join(
            F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))),
            ", ",
        ),
        F.lit(")"),
    )
    texts = F.transform(rings, ring)
    if holes is None:
        return F.concat(F.lit("POLYGON ("), F.array_join(texts, ", "), F.lit(")"))
    # A ring that is no hole closes the part before it and opens one.
    led = F.zip_with(texts, holes, lambda t, h: F.concat(F.when(h, ", ").otherwise("), ("), t))
    return F.concat(F.lit("MULTIPOLYGON ("), F.substring(F.array_join(led, ""), 4, 2**31 - 1), F.lit("))"))


# ---- measures --------------------------------------------------------------


def bbox(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def edges(rings: Column) -> Column:
    """All sides of all rings as ``ARRAY<STRUCT<x1, y1, x2, y2>>``."""

    def of_ring(r: Column) -> Column:
        ahead = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        sides = F.zip_with(
            r,
            ahead,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )
        # A closed ring repeats its first point; that side has no length.
        return F.filter(sides, lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))

    return F.flatten(F.transform(rings, of_ring))


def _total(sides: Column, term) -> Column:
    return F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + term(s))


def _cross(s: Column) -> Column:
    return s["x1"] * s["y2"] - s["x2"] * s["y1"]


def _less_holes(values: Column, holes: Column | None) -> Column:
    """Sum of the rings' unsigned values, those of holes taken away; null without rings."""
    if holes is None:
        signed = F.transform(values, lambda v, i: F.when(i > 0, -v).otherwise(v))
    else:
        signed = F.zip_with(values, holes, lambda v, h: F.when(h, -v).otherwise(v))
    return F.when(F.size(values) > 0, F.aggregate(signed, F.lit(0.0), lambda acc, v: acc + v))


def area_3857_km2(rings: Column, holes: Column | None = None) -> Column:
    """Area in Web Mercator square kilometers (inflated away from the equator)."""
    to_m = math.pi / 180 * MERCATOR_RADIUS_M

    def mercator(p: Column) -> Column:
        lat = F.radians(p["y"])
        return xy(p["x"] * to_m, F.log(F.tan(math.pi / 4 + lat / 2)) * MERCATOR_RADIUS_M)

    def area(r: Column) -> Column:
        projected = F.array(F.transform(r, mercator))
        return F.abs(_total(edges(projected), _cross)) / 2

    return _less_holes(F.transform(rings, area), holes) / 1e6


def centroid(rings: Column, holes: Column | None = None) -> Column:
    """Area-weighted centre of all parts less their holes.

    Coordinates are taken relative to the first point, which keeps the sums
    accurate for small shapes far from the origin.
    """
    origin = rings[0][0]
    near = F.transform(
        rings, lambda r: F.transform(r, lambda p: xy(p["x"] - origin["x"], p["y"] - origin["y"]))
    )

    def moments(r: Column) -> Column:
        sides = edges(F.array(r))
        turn = F.signum(_total(sides, _cross))
        return F.struct(
            (_total(sides, _cross) * turn).alias("a"),
            (_total(sides, lambda s: (s["x1"] + s["x2"]) * _cross(s)) * turn).alias("x"),
            (_total(sides, lambda s: (s["y1"] + s["y2"]) * _cross(s)) * turn).alias("y"),
        )

    parts = F.transform(near, moments)

    def whole(field: str) -> Column:
        return _less_holes(F.transform(parts, lambda m: m[field]), holes)

    a3 = whole("a") * 3
    return xy(
        origin["x"] + F.try_divide(whole("x"), a3),
        origin["y"] + F.try_divide(whole("y"), a3),
    )


def site_box(lon: Column, lat: Column, radius: float = SITE_RADIUS_DEG) -> Column:
    """Square around a site, the envelope of its circular buffer, as a bbox."""
    return F.struct(
        (lon - radius).alias("xmin"),
        (lat - radius).alias("ymin"),
        (lon + radius).alias("xmax"),
        (lat + radius).alias("ymax"),
    )


def box_rings(box: Column) -> Column:
    x0, y0, x1, y1 = (box[f] for f in ("xmin", "ymin", "xmax", "ymax"))
    return F.array(F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in meters."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


def whole_miles(meters: Column) -> Column:
    """Meters to the nearest whole meter, then to whole miles (half to even)."""
    return F.rint(F.rint(meters) * MILES_PER_M).cast("bigint")


# ---- predicates ------------------------------------------------------------


def point_in_edges(sides: Column, x: Column, y: Column) -> Column:
    """True inside (odd crossings) or on the boundary."""

    def touches(s: Column) -> Column:
        flat = (s["x2"] - s["x1"]) * (y - s["y1"]) == (s["y2"] - s["y1"]) * (x - s["x1"])
        return (
            flat
            & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
            & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
        )

    def crosses(s: Column) -> Column:
        spans = (s["y1"] > y) != (s["y2"] > y)
        at = s["x1"] + (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"])
        return F.when(spans, x < at).otherwise(F.lit(False))

    odd = F.size(F.filter(sides, crosses)) % 2 == 1
    return odd | F.exists(sides, touches)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed boxes share at least a point."""
    return (
        (a["xmin"] <= b["xmax"])
        & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"])
        & (b["ymin"] <= a["ymax"])
    )


def shadows(rings: Column) -> Column:
    """For each side of a convex polygon its normal and the polygon's shadow on it: ``ARRAY<STRUCT<nx, ny, low, high>>``."""
    points = F.flatten(rings)

    def along(s: Column) -> Column:
        nx, ny = s["y1"] - s["y2"], s["x2"] - s["x1"]
        cast = F.transform(points, lambda p: p["x"] * nx + p["y"] * ny)
        return F.struct(nx.alias("nx"), ny.alias("ny"), F.array_min(cast).alias("low"), F.array_max(cast).alias("high"))

    return F.transform(edges(rings), along)


def box_touches(box: Column, sides: Column, slack: float = 1e-12) -> Column:
    """A closed box shares at least a point with the convex polygon of these ``shadows`` (separating-axis test).

    The two are apart exactly if the normal of some side separates their shadows. The
    box's own sides are those of ``boxes_overlap``, which has to hold too.
    """

    def separates(s: Column) -> Column:
        across, up = (box["xmin"] * s["nx"], box["xmax"] * s["nx"]), (box["ymin"] * s["ny"], box["ymax"] * s["ny"])
        return (F.greatest(*across) + F.greatest(*up) < s["low"] - slack) | (s["high"] < F.least(*across) + F.least(*up) - slack)

    return ~F.exists(sides, separates)
