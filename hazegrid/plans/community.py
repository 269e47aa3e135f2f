"""Mobile community sensor: geotagging, half-hour cells, neighborhood tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.calendar import floor_half_hour, parse_timestamps
from hazegrid.functions.levels import level_flags
from hazegrid.functions.rounding import half_even
from hazegrid.operators.aggregates import cell_stats
from hazegrid.operators.quantiles import MEDIAN, grouped_stats
from hazegrid.operators.spatial import HexGrid, geotag

GRAINS = {
    "block": "geoid10",
    "neighborhood": "pri_neigh",
    "hexagon": "hexagon_id",
    "big_hexagon": "big_hexagon_id",
}


def tag_points(
    points: DataFrame,
    blocks: DataFrame | None = None,
    neighborhoods: DataFrame | None = None,
    hexagons: DataFrame | None = None,
    grid: HexGrid | None = None,
) -> DataFrame:
    """Points with the area ids of the layers given, half hour and level flags.

    A point in several shapes of a layer is listed for each, so a layer may be left out
    only where its shapes do not overlap.
    """
    if dict(points.dtypes)["time"] == "string":
        points = parse_timestamps(points, ["time"])
    layers = [
        (blocks, {"geoid10": "geoid10"}),
        (neighborhoods, {"pri_neigh": "pri_neigh"}),
        (hexagons, {"id": "hexagon_id"}),
    ]
    tagged = geotag(points, [(p, names) for p, names in layers if p is not None], grid, x="lng", y="lat")
    return level_flags(
        tagged.withColumn("thirtymins", floor_half_hour(F.col("time"))), "value", "value"
    )


def process_points(tagged: DataFrame) -> dict[str, DataFrame]:
    """The four half-hour tables. Keep ``tagged`` written or cached: it is read by each."""
    return {g: cell_stats(tagged, key, "thirtymins", "value") for g, key in GRAINS.items()}


def process_points_long(tagged: DataFrame) -> DataFrame:
    """The four tables one below the other, made in one pass: ``grain, cell, thirtymins, ...``."""
    cells = [F.struct(F.lit(g).alias("grain"), F.col(key).cast("string").alias("cell")) for g, key in GRAINS.items()]
    long = tagged.select("thirtymins", "value", "harmful", "not_harmful", F.inline(F.array(*cells)))
    return cell_stats(long, ["grain", "cell"], "thirtymins", "value")


def neighborhood_table(
    tagged: DataFrame, area: Sequence[str] = ("pri_neigh",), quantiles: Mapping[str, float] = MEDIAN
) -> DataFrame:
    """Half hour x block x rounded position statistics, all neighborhoods at once."""
    rounded = tagged.withColumns(
        {"lat_r": half_even(F.col("lat"), 5), "lng_r": half_even(F.col("lng"), 5)}
    )
    keys = [*area, "thirtymins", "geoid10", "lat_r", "lng_r"]
    return grouped_stats(rounded, keys, "value", quantiles=quantiles)
