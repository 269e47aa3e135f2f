"""Spatial operators against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.functions import geometry as G
from hazegrid.operators import joins as J
from hazegrid.operators import spatial as P

SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
NEXT = "POLYGON ((2 0, 4 0, 4 2, 2 2, 2 0))"
HOLED = "POLYGON ((0 4, 4 4, 4 8, 0 8, 0 4), (1 5, 3 5, 3 7, 1 7, 1 5))"
TWO = "MULTIPOLYGON (((10 0, 11 0, 11 1, 10 0)), ((12 0, 13 0, 13 1, 12 0)))"


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [("square", SQUARE), ("next", NEXT), ("holed", HOLED), ("two", TWO)]
    df = spark.createDataFrame(rows, "name string, wkt string")
    return df.select("name", G.rings_from_wkt(F.col("wkt")).alias("rings"))


@pytest.mark.parametrize("size", [0.3, 1.0, 50.0])
def test_points_in_polygons(spark, shapes, size):
    points = {
        1: ((1.0, 1.0), {"square"}),
        2: ((2.0, 1.0), {"square", "next"}),  # shared edge
        3: ((2.0, 2.0), {"square", "next"}),  # shared corner
        4: ((0.0, 0.0), {"square"}),
        5: ((2.0, 6.0), set()),  # in the hole
        6: ((1.0, 6.0), {"holed"}),  # on the hole's edge
        7: ((0.5, 4.5), {"holed"}),
        8: ((10.9, 0.5), {"two"}),
        9: ((12.2, 0.9), set()),
        10: ((-5.0, 1.0), set()),
        11: ((None, 1.0), set()),
    }
    df = spark.createDataFrame([(i, *xy) for i, (xy, _) in points.items()], "id int, lon double, lat double")
    rows = P.locate(df, shapes, ["name"], grids=[size]).collect()
    for i, (_, want) in points.items():
        got = [r["name"] for r in rows if r["id"] == i]
        assert set(got) - {None} == want and len(got) == max(1, len(want)), i


def test_random_points_against_hexagon_numbers(spark):
    grid = P.HexGrid(xmin=-88.0, ymax=42.0, width=0.02, cols=12, rows=9)
    rng = random.Random(3)
    pts = [(i, rng.uniform(-88.03, -87.74), rng.uniform(41.83, 42.03)) for i in range(3000)]
    df = spark.createDataFrame(pts, "pid int, lon double, lat double")
    by_number = df.withColumn("n", grid.id_at("lon", "lat"))
    both = P.locate(by_number, grid.table(spark).select("id", "rings"), ["id"], grids=[0.01])
    assert both.where("NOT (n <=> id)").count() == 0
    assert 1000 < both.where("id IS NOT NULL").count() < 3000


def _star(n, x=0.0, y=0.0, size=1.0):
    """A ring of ``n`` sides whose distance from the middle goes up and down."""
    ring = []
    for i in range(n):
        a, r = 2 * math.pi * i / n, size * (1 + 0.3 * math.sin(9 * 2 * math.pi * i / n))
        ring.append((x + r * math.cos(a), y + r * math.sin(a)))
    return [ring + ring[:1]]


def _inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1)
    return odd


RINGS = "array<array<struct<x:double,y:double>>>"


def test_shapes_of_many_sides(spark):
    """Their cells are flat; simple and large shapes, holes and neighbours in one layer."""
    hole = _star(500, 0.0, 0.0, 0.5)[0]
    rows = [("star", [*_star(3000), hole]), ("hole", [hole]), ("far", _star(400, 9.0, 1.0, 0.01)), ("square", [[(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0)]])]
    shapes = spark.createDataFrame(rows, f"name string, rings {RINGS}")
    (grids,) = P.layer_grids([shapes])
    assert any(w > 64 * h for w, h in grids) and any(w == h for w, h in grids)
    rng = random.Random(4)
    points = [(i, rng.uniform(-1.5, 1.5), rng.uniform(-1.5, 1.5)) for i in range(1500)]
    points += [(2000 + i, rng.uniform(8.985, 9.015), rng.uniform(0.985, 1.015)) for i in range(300)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {(r["id"], r["name"]) for r in P.locate(df, shapes, ["name"]).collect()}
    want = {(i, name) for i, x, y in points for name, rings in rows if _inside([[*r, r[0]] for r in rings], x, y)}
    assert got == want | {(i, None) for i, _, _ in points if i not in {k for k, _ in want}}


def test_a_cell_has_few_sides_of_a_large_shape(spark):
    """What a point is compared with does not grow with the shape."""
    most = {}
    for n in (1_000, 100_000):
        shapes = spark.createDataFrame([("star", _star(n))], f"name string, rings {RINGS}")
        cells = P.cover(shapes, ["name"], P.layer_grids([shapes])[0])
        r = cells.agg(F.avg(F.size("__edges")).alias("mean"), F.sum(F.size("__edges")).alias("all")).first()
        most[n] = r["mean"]
        assert r["all"] < 16 * n
    assert most[100_000] < 2 * most[1_000] < 200


def test_hexagon_edge_takes_lowest(spark):
    grid = P.HexGrid(xmin=0.0, ymax=10.0, width=2.0, cols=3, rows=3)
    df = spark.createDataFrame([(1.0, 10.0), (0.0, 10.0), (50.0, 50.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(grid.id_at("x", "y")).collect()]
    assert got == [0, 0, None, None]


def test_area_centroid_and_box(spark, shapes):
    rows = {r["name"]: r for r in shapes.select("name", G.centroid(F.col("rings")).alias("c"), G.bbox(F.col("rings")).alias("b"), G.area_3857_km2(F.col("rings")).alias("a")).collect()}
    assert rows["square"]["c"]["x"] == pytest.approx(1.0) and rows["holed"]["c"]["y"] == pytest.approx(6.0)
    assert (rows["holed"]["b"]["ymin"], rows["holed"]["b"]["xmax"]) == (4.0, 4.0)
    side = math.radians(2) * 6378137 / 1000
    up = 6378137 / 1000 * math.log(math.tan(math.pi / 4 + math.radians(2) / 2))
    assert rows["square"]["a"] == pytest.approx(side * up)


def test_wkt_round_trip(spark, shapes):
    again = shapes.select("name", G.rings_from_wkt(G.rings_to_wkt(F.col("rings"))).alias("rings"))
    assert sorted(again.collect()) == sorted(shapes.collect())


def test_boxes_meet_convex_shapes(spark):
    grid = P.HexGrid(xmin=0.0, ymax=5.0, width=1.0, cols=6, rows=6).table(spark)
    rng = random.Random(1)
    boxes = []
    for i in range(60):
        x, y, w = rng.uniform(-1, 7), rng.uniform(0, 6), rng.uniform(0.05, 0.8)
        boxes.append((i, (x, y, x + w, y + w)))
    df = spark.createDataFrame(boxes, "k int, box struct<xmin double, ymin double, xmax double, ymax double>")
    got = {(r["k"], r["id"]) for r in P.polygons_touching(df, ["k"], grid, ["id"], sizes=[0.4]).collect()}
    want = set()
    for i, b in boxes:
        found = False
        for h in grid.collect():
            ring = [(p["x"], p["y"]) for p in h["rings"][0]][:-1]
            if _meet(ring, [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]):
                want.add((i, h["id"]))
                found = True
        if not found:
            want.add((i, None))
    assert got == want


def _meet(a, b):
    for ring in (a, b):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            nx, ny = y1 - y2, x2 - x1
            pa, pb = [x * nx + y * ny for x, y in a], [x * nx + y * ny for x, y in b]
            if max(pa) < min(pb) - 1e-12 or max(pb) < min(pa) - 1e-12:
                return False
    return True


def test_radius_join(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-88, -87.5), rng.uniform(41.5, 42)) for i in range(150)]
    df = spark.createDataFrame(pts, "s int, lon double, lat double")
    got = {(r["s"], r["s_2"]) for r in P.within_radius(df, df, 4000.0).collect()}

    def meters(a, b):
        p1, p2 = math.radians(a[2]), math.radians(b[2])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    assert got == {(a[0], b[0]) for a in pts for b in pts if meters(a, b) <= 4000.0}


def test_shuffle_join_equals_broadcast(spark):
    fact = spark.createDataFrame([(1, "x")] * 50 + [(2, "y"), (3, "z"), (None, "n")], "k int, v string")
    look = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, w string")
    for how in ("left", "inner", "left_semi"):
        small = J.join_lookup(fact, look, ["k"], how, broadcast=True)
        large = J.join_lookup(fact, look, ["k"], how, broadcast=False)
        assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    plan = J.join_lookup(fact, look, ["k"], broadcast=False)._jdf.queryExecution().toString()
    assert "rightHint=(strategy=broadcast)" not in plan


def test_locate_beyond_broadcast(spark, shapes, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "id int, lon double, lat double")
    want = sorted(P.locate(df, shapes, ["name"]).collect(), key=str)
    monkeypatch.setattr(J, "fits_in_memory", lambda *a, **k: False)
    assert sorted(P.locate(df, shapes, ["name"]).collect(), key=str) == want


def test_city_extent_sizes_grid(spark):
    box = spark.createDataFrame([(-87.94, 41.64, -87.52, 42.02)], "xmin double, ymin double, xmax double, ymax double")
    grid = P.HexGrid.over(box)
    # 22 miles across, 26 miles down
    assert (grid.cols, grid.rows) == (int(22 / math.sin(math.pi / 3)) + 1, 27)
    assert grid.table(spark).count() == grid.cols * grid.rows


def test_shapes_of_very_different_extent(spark):
    """A shape a thousand times the others, with many of them inside and outside."""
    def ring(x, y, w):
        return [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]

    shapes = [("big", ring(0.0, 0.0, 10.0))] + [(f"s{i}", ring(i * 0.5, i * 0.3, 0.01)) for i in range(40)]
    kind = "name string, rings array<array<struct<x double, y double>>>"
    df = spark.createDataFrame(shapes, kind)
    points = [(i, i * 0.5 + 0.005, i * 0.3 + 0.005) for i in range(40)] + [(100, -1.0, 5.0), (101, 3.3, 9.9)]
    pts = spark.createDataFrame(points, "id int, lon double, lat double")
    assert len(P.cell_sizes(df, G.bbox(F.col("rings")))) == 2
    got = sorted((r["id"], r["name"] or "") for r in P.locate(pts, df, ["name"]).collect())
    want = [(i, f"s{i}") for i in range(40)] + [(i, "big") for i, x, y in points if 0 <= x <= 10 and 0 <= y <= 10] + [(100, "")]
    assert got == sorted(want)
    boxes = spark.createDataFrame([(1, (1.0, 0.6, 1.001, 0.601)), (2, (0.0, 0.0, 20.0, 20.0)), (3, (-3.0, -3.0, -2.0, -2.0))],
                                  "k int, box struct<xmin double, ymin double, xmax double, ymax double>")
    met = {(r["k"], r["name"]) for r in P.polygons_touching(boxes, ["k"], df, ["name"]).collect()}
    assert met == {(1, "big"), (1, "s2"), (3, None), (2, "big"), *((2, f"s{i}") for i in range(40))}


def test_radius_join_at_the_poles_and_the_date_line(spark):
    rng = random.Random(4)
    pts = [(0, 10.0, 85.0), (1, 10.13, 85.0), (2, 179.999, 0.0), (3, -179.9995, 0.001), (4, 0.0, 89.9995), (5, 180.0, 89.9995),
           (6, 0.0, 90.0), (7, 33.0, -89.9999), (8, -150.0, -89.9999), (9, 180.0, 10.0), (10, -180.0, 10.0)]
    pts += [(20 + i, rng.uniform(-180, 180), rng.choice([-1, 1]) * (90 - rng.expovariate(20))) for i in range(60)]
    pts += [(200 + i, rng.choice([-1, 1]) * (180 - rng.expovariate(200)), rng.uniform(-0.02, 0.02)) for i in range(60)]
    df = spark.createDataFrame(pts, "s int, lon double, lat double")

    def meters(a, b):
        p1, p2 = math.radians(a[2]), math.radians(b[2])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for radius in (1500.0, 40.0):
        rows = P.within_radius(df, df, radius).collect()
        got = [(r["s"], r["s_2"]) for r in rows]
        assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in pts for b in pts if meters(a, b) <= radius}
    assert (0, 1) in {(r["s"], r["s_2"]) for r in P.within_radius(df, df, 1500.0).collect()}


def test_shapes_of_several_parts(spark):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((10 0, 12 0, 12 2, 10 2, 10 0)))"
    parts = G.parts_from_wkt(F.lit(wkt))
    row = spark.range(1).select(
        F.flatten(parts).alias("rings"), G.holes_of(parts).alias("holes"), F.size(parts).alias("n")
    )
    got = row.select(
        "n", "holes", G.centroid(F.col("rings"), F.col("holes")).alias("c"),
        G.area_3857_km2(F.col("rings"), F.col("holes")).alias("a"),
        G.rings_to_wkt(F.col("rings"), F.col("holes")).alias("again"),
        *[G.area_3857_km2(F.slice(F.col("rings"), i, 1)).alias(f"a{i}") for i in (1, 2, 3)],
    ).first()
    assert got["n"] == 2 and got["holes"] == [False, True, False]
    assert got["a"] == pytest.approx(got["a1"] - got["a2"] + got["a3"])
    assert (got["c"]["x"], got["c"]["y"]) == (pytest.approx((32 - 1.5 + 44) / 19), pytest.approx((32 - 1.5 + 4) / 19))
    assert got["again"].replace(".0", "") == wkt


def test_grids_are_listed_once_for_each_box(spark):
    """No list of grids is made for the rows below a distinct, only to drop empty ones."""
    rows = spark.range(40).selectExpr("id % 4 AS k", "double(id % 4) AS x")
    boxes = rows.distinct().select("k", G.site_box(F.col("x"), F.col("x")).alias("box"))
    rings = "array(array(struct(x, x AS y), struct(x + 1 AS x, x AS y), struct(x AS x, x + 1 AS y), struct(x, x AS y))) AS rings"
    shapes = rows.distinct().selectExpr("k AS id", rings)
    met = P.polygons_touching(boxes, ["k"], shapes, ["id"], [0.25, 1.0])
    assert "size(filter(" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["k"], r["id"]) for r in met.collect()} >= {(i, i) for i in range(4)}
