"""Daily comparison of the networks and its map layers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.clean import rename_or_drop
from hazegrid.functions.rounding import half_even, settled
from hazegrid.operators.aggregates import (
    cell_totals,
    rollup_with_cell_shares,
    summary_rollup,
    summary_with_shares,
    totals_with_cell_shares,
)
from hazegrid.operators.filters import min_support
from hazegrid.operators.joins import combine_sources, join_lookup, semi_join
from hazegrid.operators.spatial import polygons_touching
from hazegrid.session import materialize

# Support a day needs to be compared.
AQ_SUPPORT = {"count": 500, "hex_ct": 5}
EPA_SUPPORT = {"count": 12}
PA_SUPPORT = {"count": 250}


def site_daily_rollup(daily: DataFrame) -> DataFrame:
    """Site-days to days. The shares count site-days whose own share is 1, by weight."""
    return summary_with_shares(daily, ["Daily"], sums=["sum", "count"], maxes=["max"])


def hexagon_daily_rollup(by_hexagon: DataFrame, cell: str = "hexagon_id") -> DataFrame:
    """Half-hour hexagon table to days, with cell shares and cell count."""
    return rollup_with_cell_shares(by_hexagon, ["Daily"], cell)


def daily_by_source(
    epa: DataFrame, purpleair: DataFrame, by_hexagon: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return site_daily_rollup(epa), site_daily_rollup(purpleair), hexagon_daily_rollup(by_hexagon)


def hexagons_near(sites: DataFrame, key: list[str], hexagons: DataFrame) -> DataFrame:
    """Ids of hexagons touching a site's square (``box``)."""
    pairs = polygons_touching(sites, key, hexagons, ["id"])
    return pairs.where(F.col("id").isNotNull()).select(F.col("id").alias("hexagon_id")).distinct()


def near_sensor_daily(
    by_hexagon: DataFrame, sites: DataFrame, key: list[str], hexagons: DataFrame
) -> DataFrame:
    """Daily table of the hexagons near a network's sensors."""
    near = hexagons_near(sites, key, hexagons)
    return hexagon_daily_rollup(semi_join(by_hexagon, near, ["hexagon_id"]))


def scoped_daily_rollup(
    by_hexagon: DataFrame, near: Mapping[str, DataFrame], cell: str = "hexagon_id", every: str = "all"
) -> DataFrame:
    """Daily tables of all hexagons and of those near each network, in one pass: ``scope, Daily, ...``.

    ``near`` has the hexagon ids of each network (``hexagons_near``). Half hours fold to
    days of a hexagon once; only these are listed for the scopes that the hexagon is in.
    """
    ids = [df.select(F.col("hexagon_id").alias(cell), F.lit(name).alias("scope")) for name, df in near.items()]
    days = cell_totals(by_hexagon, ["Daily"], cell)
    scopes = F.array(F.lit(every))
    if ids:
        # A hexagon has at most one entry for each network.
        flags = reduce(DataFrame.union, ids).groupBy(cell).agg(F.collect_set("scope").alias("__near"))
        days = join_lookup(days, flags, [cell])
        scopes = F.concat(scopes, F.coalesce("__near", F.array().cast("array<string>")))
    listed = days.withColumn("scope", F.explode(scopes))
    return totals_with_cell_shares(listed, ["scope", "Daily"], cell)


def daily_comparison(
    aq: DataFrame,
    epa: DataFrame,
    purpleair: DataFrame,
    aq_support: Mapping[str, int] = AQ_SUPPORT,
    epa_support: Mapping[str, int] = EPA_SUPPORT,
    pa_support: Mapping[str, int] = PA_SUPPORT,
) -> DataFrame:
    """Days with enough support, the three networks side by side, with the year."""
    combined = combine_sources(
        min_support(aq, aq_support), min_support(epa, epa_support), min_support(purpleair, pa_support)
    )
    return combined.withColumn("Year", F.year("Daily"))


def daily_map_layers(
    epa: DataFrame,
    epa_squares: DataFrame,
    purpleair: DataFrame,
    by_hexagon: DataFrame,
    hexagons: DataFrame,
    common: DataFrame,
) -> dict[str, DataFrame]:
    """Station squares, sensor points and hexagons with the day's mean, common days only.

    ``epa_squares`` has one row per station and site number (``box``).
    """
    days = materialize(common.select(F.col("Daily").alias("Date")).distinct())
    names = {"Daily": "Date", "mean": "Average PM2.5"}

    def finish(df: DataFrame, source: str) -> DataFrame:
        rounded = df.withColumns({"mean": half_even(settled(F.col("mean")), 2), "Source": F.lit(source)})
        return semi_join(rename_or_drop(rounded, names), days, ["Date"])

    stations = join_lookup(
        epa.where(F.col("mean").isNotNull()).select("Daily", "value_represented", "mean", "count"),
        epa_squares.select("value_represented", "site_number", "box").distinct(),
        ["value_represented"],
    ).withColumnRenamed("value_represented", "EPA Station")
    points = summary_rollup(purpleair, ["Daily", "lat", "lon"], ["sum", "count"]).select(
        "Daily", "lat", "lon", "mean", "count"
    )
    cells = summary_rollup(
        by_hexagon.withColumnRenamed("hexagon_id", "id"), ["Daily", "id"], ["sum", "count"]
    ).select("Daily", "id", "mean", "count")
    shaped = join_lookup(cells, hexagons.select("id", "rings"), ["id"], "inner")
    return {
        "epa": finish(stations, "EPA"),
        "purpleair": finish(points, "PurpleAir"),
        "hexagons": finish(shaped, "AirQuality"),
    }


def monthly_map_frames(layers: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The layers with year, month and day text, for months all of them have."""
    dated = {
        name: df.withColumns(
            {
                "year": F.year("Date"),
                "month": F.month("Date"),
                "Date": F.date_format("Date", "yyyy-MM-dd"),
            }
        )
        for name, df in layers.items()
    }
    months = [df.select("year", "month").distinct() for df in dated.values()]
    shared = materialize(reduce(lambda a, b: a.join(b, ["year", "month"], "left_semi"), months))
    return {name: semi_join(df, shared, ["year", "month"]) for name, df in dated.items()}
