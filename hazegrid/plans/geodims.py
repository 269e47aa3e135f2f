"""Geographic dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import geometry as G
from hazegrid.functions.clean import code_prefix
from hazegrid.operators.spatial import HexGrid, extent


def _measured(raw: DataFrame) -> DataFrame:
    """Box and projected area; shapes of several parts have a ``holes`` column."""
    holes = F.col("holes") if "holes" in raw.columns else None
    rings = F.col("rings")
    return raw.withColumns({"bbox": G.bbox(rings), "area_3857_km2": G.area_3857_km2(rings, holes)})


def blocks_table(raw: DataFrame) -> DataFrame:
    """Census blocks with their 12-digit group code and projected area.

    Rows that are equal in all columns are one; different shapes of one code stay.
    """
    return _measured(raw.distinct()).select(
        code_prefix(F.col("geoid10")).alias("geo_12"), "geoid10", "rings", "bbox", "area_3857_km2"
    )


def neighborhoods_table(raw: DataFrame) -> DataFrame:
    return _measured(raw)


def big_hexagons(neighborhoods: DataFrame, diameter_miles: float = 1.0) -> tuple[HexGrid, DataFrame]:
    """Hexagon grid over all neighborhoods, and its table."""
    grid = HexGrid.over(extent(neighborhoods), diameter_miles)
    return grid, grid.table(neighborhoods.sparkSession)


def build_dimensions(
    raw_blocks: DataFrame, raw_neighborhoods: DataFrame, hexagons: DataFrame
) -> dict[str, DataFrame]:
    neighborhoods = neighborhoods_table(raw_neighborhoods)
    _, big = big_hexagons(neighborhoods)
    return {
        "blocks": blocks_table(raw_blocks),
        "neighborhoods": neighborhoods,
        "hexagons": hexagons.select("id", "rings", G.bbox(F.col("rings")).alias("bbox")),
        "big_hexagons": big.select("id", "rings", G.bbox(F.col("rings")).alias("bbox")),
    }
