"""Spatial joins as equi-joins on grid cells, and the hexagon grid.

A bare geometric predicate would plan as a nested loop. Polygons are instead cut
to the cells of a fixed grid, points carry the one cell they lie in, and the
exact test is part of the join condition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions import geometry as G
from hazegrid.operators.joins import join_lookup

MIN_CELL = 1e-4  # degrees
#: Shapes up to this many powers of two apart share one grid.
POWERS = 3
# Shapes touch at most four cells of their grid.
CELLS = 4
#: Sides up to which a shape's cells are as high as they are wide.
FEW_SIDES = 32
#: Powers of two between the heights of cells, and the most that a cell is cut into.
SLAB_POWERS, MOST_SLABS = 4, 16


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size)


def _cells_of_box(df: DataFrame, box: Column, size: Column) -> DataFrame:
    """One row per grid cell the box touches: ``__cx``, ``__cy``."""
    xs = F.sequence(_cell(box["xmin"], size), _cell(box["xmax"], size))
    ys = F.sequence(_cell(box["ymin"], size), _cell(box["ymax"], size))
    return df.withColumn("__cx", F.explode_outer(xs)).withColumn("__cy", F.explode_outer(ys))


def _extent_of(box: Column) -> Column:
    return F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], F.lit(MIN_CELL))


def cell_sizes(boxes: DataFrame, box: Column) -> list[float]:
    """Grid sizes that suit a layer, ascending: one for shapes of about the same extent.

    A shape touches at most four cells of the grid that is no smaller than itself,
    however much larger than the others it is. Only the distinct powers of two of the
    extents reach the driver, at most a few dozen.
    """
    return layer_sizes([(boxes, box)])[0]


def layer_sizes(layers: Sequence[tuple[DataFrame, Column]]) -> list[list[float]]:
    """``cell_sizes`` of several layers, looked up together."""
    powers = [
        boxes.select(F.lit(i).alias("layer"), F.ceil(F.log2(_extent_of(box))).alias("power"))
        for i, (boxes, box) in enumerate(layers)
    ]
    found = reduce(lambda a, b: a.union(b), powers).distinct().collect()
    return [_merged({r.power for r in found if r.layer == i and r.power is not None}) for i in range(len(layers))]


def _merged(powers: set[int]) -> list[float]:
    """Sizes of the grids for shapes of these powers of two, ascending."""
    sizes, left = [], sorted(powers)
    while left:
        top = left[-1]
        sizes.insert(0, 2.0**top)
        left = [p for p in left if p <= top - POWERS]
    return sizes or [MIN_CELL]


def _size_of(box: Column, sizes: Sequence[float]) -> Column:
    """The smallest grid that is no smaller than the box."""
    chosen = F.lit(sizes[-1])
    for size in reversed(sizes[:-1]):
        chosen = F.when(_extent_of(box) <= size, size).otherwise(chosen)
    return chosen


def _height_power(rings: Column) -> Column:
    """Power of two of the height that a shape's cells should have; null for a shape of few sides.

    Cells as high as the sides' mean rise hold a handful of sides each, however many the
    shape has, and list each side about twice.
    """
    sides = G.edges(rings)
    rise = F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + F.abs(s["y2"] - s["y1"]))
    power = F.ceil(F.log2(rise / F.size(sides)) / SLAB_POWERS) * SLAB_POWERS
    return F.when(F.size(sides) > FEW_SIDES, power)


Grid = tuple[float, float]  # width and height of its cells


def layer_grids(layers: Sequence[DataFrame]) -> list[list[Grid]]:
    """For each layer of polygons the grids that suit its shapes, ascending.

    Only the distinct powers of two of extents and heights reach the driver.
    """
    powers = [
        p.select(
            F.lit(i).alias("layer"),
            F.ceil(F.log2(_extent_of(G.bbox(F.col("rings"))))).alias("power"),
            _height_power(F.col("rings")).alias("high"),
        )
        for i, p in enumerate(layers)
    ]
    found = reduce(lambda a, b: a.union(b), powers).where("power IS NOT NULL").distinct().collect()
    out = []
    for i in range(len(layers)):
        mine = [r for r in found if r.layer == i]
        sizes = _merged({r.power for r in mine})
        width = lambda r: next(s for s in sizes if 2.0**r.power <= s)
        out.append(sorted({(width(r), _height(width(r), r.high)) for r in mine}) or [(MIN_CELL, MIN_CELL)])
    return out


def _height(width: float, power: int | None) -> float:
    return width if power is None else min(width, max(2.0**power, width / 2**MOST_SLABS))


def cover(polygons: DataFrame, columns: list[str], grids: Sequence[Grid]) -> DataFrame:
    """Polygons cut to grid cells: ``columns``, ``__width``, ``__height``, ``__cx``, ``__cy``, ``__box``, ``__edges``.

    Only the sides that matter for points of the cell stay: those that reach into
    the cell's rows and are not wholly to its left (crossings are counted to the
    right). Cells left without sides are outside and are dropped. The cells of a shape of
    many sides are flat, so each has only the few sides that cross its height; they are
    made from the sides, not by looking for them in each cell.
    """
    sizes = sorted({w for w, _ in grids})
    width, height = F.col("__width"), F.col("__height")
    box = F.col("__box")
    slack = 1e-6
    shapes = polygons.select(
        *columns, G.bbox(F.col("rings")).alias("__box"), G.edges(F.col("rings")).alias("__all"), _height_power(F.col("rings")).alias("__power")
    ).withColumn("__width", _size_of(box, sizes))
    flat = F.least(width, F.greatest(F.pow(F.lit(2.0), F.col("__power")), width / 2**MOST_SLABS))
    # Greatest and least pass over nulls, so a shape of few sides is told by its power.
    shapes = shapes.withColumn("__height", F.when(F.col("__power").isNull(), width).otherwise(flat))
    x0, y0 = F.col("__cx") * width, F.col("__cy") * width
    matters = lambda s: (
        (F.greatest(s["y1"], s["y2"]) >= y0 - slack * width)
        & (F.least(s["y1"], s["y2"]) <= y0 + width + slack * width)
        & (F.greatest(s["x1"], s["x2"]) >= x0 - slack * width)
    )
    kept = [*columns, "__width", "__height", "__cx", "__cy", "__box", "__edges"]
    plain = shapes.where("__power IS NULL") if any(w != h for w, h in grids) else shapes.withColumn("__height", width)
    cells = _cells_of_box(plain, box, width).withColumn("__edges", F.filter("__all", matters))
    cells = cells.where(F.size("__edges") > 0).select(*kept)
    if all(w == h for w, h in grids):
        return cells
    many = shapes.where("__power IS NOT NULL").withColumn("__id", F.monotonically_increasing_id())
    shape = F.struct(*columns, "__width", "__height", "__box").alias("__shape")
    side = F.col("__side")
    rows = F.sequence(
        F.greatest(_cell(F.least(side["y1"], side["y2"]) - slack * height, height), _cell(box["ymin"], height)),
        F.least(_cell(F.greatest(side["y1"], side["y2"]) + slack * height, height), _cell(box["ymax"], height)),
    )
    across = F.sequence(
        _cell(box["xmin"], width),
        F.least(_cell(F.greatest(side["x1"], side["x2"]) + slack * width, width), _cell(box["xmax"], width)),
    )
    listed = many.withColumn("__side", F.explode("__all")).withColumn("__cy", F.explode(rows)).withColumn("__cx", F.explode(across))
    # A cell's list has the sides that cross its height.
    slabs = listed.groupBy("__id", "__cx", "__cy").agg(F.first(shape).alias("__shape"), F.collect_list("__side").alias("__edges"))
    return cells.unionByName(slabs.select("__shape.*", "__cx", "__cy", "__edges").select(*kept))


def locate(
    points: DataFrame,
    polygons: DataFrame,
    columns: list[str],
    x: str = "lon",
    y: str = "lat",
    grids: Sequence[Grid | float] | None = None,
) -> DataFrame:
    """Left point-in-polygon join adding ``columns``; boundaries count as inside.

    A point in several polygons gives several rows; in none, one row of nulls. With
    shapes of very different extent or number of sides, a point looks up one cell of each
    grid. ``grids`` are widths and heights of cells, one number for square ones.
    """
    pairs = [g if isinstance(g, tuple) else (g, g) for g in grids] if grids else layer_grids([polygons])[0]
    px, py = F.col(x), F.col(y)

    def inside(box: Column, edges: Column) -> Column:
        # The box is compared first: it is compiled code, the walk along the sides is not.
        return (
            px.between(box["xmin"], box["xmax"])
            & py.between(box["ymin"], box["ymax"])
            & G.point_in_edges(edges, px, py)
        )

    covered = cover(polygons, columns, pairs)
    grown = CELLS if all(w == h for w, h in pairs) else 2 * CELLS
    if len(pairs) == 1:
        keyed = points.withColumns({"__cx": _cell(px, pairs[0][0]), "__cy": _cell(py, pairs[0][1])})
        met = inside(F.col("__box"), F.col("__edges"))
        joined = join_lookup(keyed, covered, ["__cx", "__cy"], condition=met, grown=grown)
        return joined.drop("__cx", "__cy", "__box", "__edges", "__width", "__height")
    found = points
    for i, (width, height) in enumerate(pairs):
        # Shapes that meet in one cell, each with the sides of that cell.
        shapes = F.collect_list(F.struct(*columns, "__box", "__edges")).alias(f"__shapes{i}")
        own = covered.where((F.col("__width") == width) & (F.col("__height") == height))
        lookup = own.groupBy("__cx", "__cy").agg(shapes)
        keyed = found.withColumns({"__cx": _cell(px, width), "__cy": _cell(py, height)})
        found = join_lookup(keyed, lookup, ["__cx", "__cy"], grown=grown).drop("__cx", "__cy")
    every = F.concat(*[F.coalesce(F.col(f"__shapes{i}"), F.array()) for i in range(len(pairs))])
    hits = F.transform(
        F.filter(every, lambda s: inside(s["__box"], s["__edges"])), lambda s: F.struct(*[s[c].alias(c) for c in columns])
    )
    shown = found.select(*points.columns, F.explode_outer(hits).alias("__hit"))
    return shown.select(*points.columns, *[F.col("__hit")[c].alias(c) for c in columns])


def polygons_touching(
    boxes: DataFrame,
    key: list[str],
    polygons: DataFrame,
    columns: list[str],
    sizes: Sequence[float] | None = None,
) -> DataFrame:
    """Left join of rectangles (``box``) with convex polygons they share a point with.

    ``key`` identifies a rectangle. A pair is compared on the grid of the larger of
    the two; each side is listed on its own grid and the coarser ones. A pair meeting
    in several cells is kept once, in the cell that holds the lower left corner of the
    common box, so no distinct is needed afterwards. What the exact test needs of a polygon
    is computed once, not for each pair.
    """
    shapes = polygons.select(
        *columns, G.shadows(F.col("rings")).alias("__sides"), G.bbox(F.col("rings")).alias("__box")
    )
    sizes = list(sizes or cell_sizes(boxes.select("box").union(shapes.select("__box")), F.col("box")))
    grids = F.array(*[F.lit(s) for s in sizes])

    def listed(df: DataFrame, box: str, own: str) -> DataFrame:
        sized = df.withColumn(own, _size_of(F.col(box), sizes))
        every = sized.withColumn("__size", F.explode_outer(F.filter(grids, lambda s: s >= F.col(own))))
        return _cells_of_box(every, F.col(box), F.col("__size"))

    size = F.greatest("__own", "__own_2")
    home = lambda f: _cell(F.greatest(F.col(f"box.{f}"), F.col(f"__box.{f}")), size)
    met = (
        (F.col("__size") == size)
        & G.boxes_overlap(F.col("box"), F.col("__box"))
        & (F.col("__cx") == home("xmin"))
        & (F.col("__cy") == home("ymin"))
        & G.box_touches(F.col("box"), F.col("__sides"))
    )
    pairs = join_lookup(
        listed(boxes.select(*key, "box"), "box", "__own"),
        listed(shapes, "__box", "__own_2"),
        ["__size", "__cx", "__cy"],
        "inner",
        condition=met,
        grown=CELLS * len(sizes),
    ).select(*key, *columns)
    return boxes.join(pairs, key, "left")


def within_radius(
    left: DataFrame, right: DataFrame, radius_m: float, x: str = "lon", y: str = "lat"
) -> DataFrame:
    """Pairs of locations at most ``radius_m`` apart, with ``meters`` and ``miles``.

    Right columns get the suffix ``_2``. Bands of latitude are one radius high, and
    each is cut into as many cells around the globe as leave the partners of a
    location in its own or a neighboring cell: wide ones near the poles, at last one
    for the whole band. Cells are counted around the globe, so those on both sides of
    180 degrees are neighbors. Candidates are a constant factor of the pairs returned.
    """
    reach = radius_m / G.EARTH_RADIUS_M * 1.001  # as an angle
    step = math.degrees(reach)

    def cells_around(band: Column) -> Column:
        # The highest latitude that a partner of the band's locations can have.
        high = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * step + step, F.lit(90.0))
        sine = F.lit(math.sin(min(reach, math.pi / 2))) / F.cos(F.radians(high))
        wide = F.when((sine >= 1) | (high >= 90.0), 360.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))))
        return F.greatest(F.floor(F.lit(360.0) / wide), F.lit(1)).cast("bigint")

    def column_of(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("bigint"), n)

    band = _cell(F.col(y), step)
    keyed = left.withColumn("__cy", band).withColumn("__cx", column_of(F.col(x), cells_around(F.col("__cy"))))
    other = right.withColumnsRenamed({c: f"{c}_2" for c in right.columns})
    own = _cell(F.col(f"{y}_2"), step)
    spread = other.withColumn("__cy", F.explode(F.sequence(own - 1, own + 1))).withColumn("__n", cells_around(F.col("__cy")))
    at = column_of(F.col(f"{x}_2"), F.col("__n"))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(at + i, F.col("__n"))))
    spread = spread.withColumn("__cx", F.explode(around)).drop("__n")
    meters = G.haversine_m(F.col(x), F.col(y), F.col(f"{x}_2"), F.col(f"{y}_2"))
    pairs = join_lookup(keyed, spread, ["__cx", "__cy"], "inner", condition=meters <= radius_m, grown=9)
    return pairs.drop("__cx", "__cy").withColumns(
        {"meters": meters, "miles": G.whole_miles(meters)}
    )


def extent(polygons: DataFrame) -> DataFrame:
    """Box around all polygons, one row."""
    box = G.bbox(F.col("rings"))
    return polygons.agg(
        F.min(box["xmin"]).alias("xmin"),
        F.min(box["ymin"]).alias("ymin"),
        F.max(box["xmax"]).alias("xmax"),
        F.max(box["ymax"]).alias("ymax"),
    )


# ---- hexagon grid ----------------------------------------------------------


@dataclass(frozen=True)
class HexGrid:
    """Pointy-top hexagons, regular in degrees, over an extent.

    Numbered row by row from the top left; odd rows are half a hexagon to the right.
    """

    xmin: float
    ymax: float
    width: float
    cols: int
    rows: int

    @property
    def radius(self) -> float:
        return self.width / math.sqrt(3)

    @property
    def row_step(self) -> float:
        return 1.5 * self.radius

    @classmethod
    def over(cls, box: DataFrame, diameter_miles: float = 1.0) -> HexGrid:
        """Grid sized from a one-row extent (see ``extent``)."""
        e = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
        row = box.select(
            "*",
            G.whole_miles(G.haversine_m(e[0], e[1], e[2], e[1])).alias("across"),
            G.whole_miles(G.haversine_m(e[0], e[1], e[0], e[3])).alias("down"),
        ).first()
        cols = int(row["across"] / (diameter_miles * math.sin(math.pi / 3))) + 1
        rows = int(row["down"] / diameter_miles) + 1
        return cls(row["xmin"], row["ymax"], (row["xmax"] - row["xmin"]) / cols, cols, rows)

    def _center(self, row: Column, col: Column) -> tuple[Column, Column]:
        shift = (row % 2) * (self.width / 2)
        return self.xmin + col * self.width + shift, self.ymax - row * self.row_step

    def table(self, spark: SparkSession) -> DataFrame:
        """``id, row, col, x, y, rings`` of every hexagon."""
        row = F.floor(F.col("id") / self.cols)
        col = F.col("id") % self.cols
        x, y = self._center(row, col)
        corners = [
            G.xy(
                F.col("x") + self.radius * math.cos(math.pi / 2 + k * math.pi / 3),
                F.col("y") + self.radius * math.sin(math.pi / 2 + k * math.pi / 3),
            )
            for k in (0, 1, 2, 3, 4, 5, 0)
        ]
        return (
            spark.range(self.rows * self.cols)
            .select("id", row.alias("row"), col.alias("col"), x.alias("x"), y.alias("y"))
            .withColumn("rings", F.array(F.array(*corners)))
        )

    def id_at(self, x: str, y: str) -> Column:
        """Number of the hexagon that holds the point, by arithmetic; no join.

        The holder is one of four centers around the point. On a shared edge the
        lowest number wins, outside the grid the result is null.
        """
        half, slack = self.width / 2, "1e-12D"
        top = f"floor(({self.ymax!r}D - `{y}`) / {self.row_step!r}D)"
        options = []
        for down in (0, 1):
            row = f"({top} + {down})"
            left = f"floor((`{x}` - {self.xmin!r}D - ({row} % 2) * {half!r}D) / {self.width!r}D)"
            for across in (0, 1):
                col = f"({left} + {across})"
                dx = f"abs(`{x}` - ({self.xmin!r}D + {col} * {self.width!r}D + ({row} % 2) * {half!r}D))"
                dy = f"abs(`{y}` - ({self.ymax!r}D - {row} * {self.row_step!r}D))"
                options.append(
                    f"if({row} BETWEEN 0 AND {self.rows - 1} AND {col} BETWEEN 0 AND {self.cols - 1}"
                    f" AND {dx} <= {half!r}D + {slack}"
                    f" AND {dy} <= {self.radius!r}D - {dx} / sqrt(3D) + {slack},"
                    f" {row} * {self.cols} + {col}, NULL)"
                )
        return F.expr(f"least({', '.join(options)})")


def geotag(
    points: DataFrame,
    layers: list[tuple[DataFrame, dict[str, str]]],
    grid: HexGrid | None = None,
    grid_column: str = "big_hexagon_id",
    x: str = "lon",
    y: str = "lat",
    grids: Sequence[Grid | float] | None = None,
) -> DataFrame:
    """Add the ids of every polygon layer, and of the hexagon grid, to each point.

    ``layers`` pairs a polygon table with ``{its column: output column}``.
    """
    every = [grids] * len(layers) if grids or not layers else layer_grids([p for p, _ in layers])
    tagged = points
    for (polygons, names), fitting in zip(layers, every, strict=True):
        renamed = polygons.withColumnsRenamed(names)
        tagged = locate(tagged, renamed, list(names.values()), x, y, fitting)
    if grid is not None:
        tagged = tagged.withColumn(grid_column, grid.id_at(x, y))
    return tagged
