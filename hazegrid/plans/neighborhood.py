"""Neighborhood drilldowns from the half-hour neighborhood table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.calendar import CALENDAR, calendar_features, calendar_to_text
from hazegrid.functions.levels import level_bins
from hazegrid.functions.names import named
from hazegrid.functions.rounding import half_even, settled
from hazegrid.operators.aggregates import summary_rollup
from hazegrid.operators.deciles import top_decile_flag
from hazegrid.operators.joins import join_lookup, with_all_bucket

GROUP = "Average PM2.5 Group"


def neighborhood_points(df: DataFrame, area: Sequence[str] = ("pri_neigh",)) -> DataFrame:
    """Half-hour position means with level group, per calendar bucket and ``All``."""
    means = summary_rollup(df, [*area, "thirtymins", "lat_r", "lng_r"], ["sum", "count"])
    mean = settled(F.col("mean"))
    binned = calendar_features(means, "thirtymins").withColumns(
        {GROUP: level_bins(mean), "mean": half_even(mean, 1)}
    )
    texts = calendar_to_text(binned, ["thirtymins", "Hourly", "Monthly", "Yearly"], ["Daily", "MonthYear"])
    shown = texts.withColumnRenamed("thirtymins", "time").select(
        *area, "lat_r", "lng_r", named(GROUP), *CALENDAR, "time", "mean"
    )
    return with_all_bucket(shown, CALENDAR)


def neighborhood_blocks(
    df: DataFrame, period: str, blocks: DataFrame | None = None, area: Sequence[str] = ("pri_neigh",)
) -> DataFrame:
    """Period means per block, the top decile of each period marked, with shapes.

    A block mean is total over count, so half-hour sums go straight to the period.
    """
    timed = calendar_features(df, "thirtymins")
    means = summary_rollup(timed, [*area, period, "geoid10"], ["sum", "count"])
    flagged = top_decile_flag(means, [*area, period], name=GROUP)
    shown = calendar_to_text(flagged.withColumn("mean", half_even(F.col("mean"), 2)), [period]).select(
        *area, "geoid10", named(GROUP), period, "mean", "count"
    )
    if blocks is None:
        return shown
    return join_lookup(shown, blocks.select("geoid10", "rings"), ["geoid10"])


def neighborhood_series(
    df: DataFrame, period: str, area: Sequence[str] = ("pri_neigh",)
) -> DataFrame:
    """Period mean per neighborhood."""
    timed = calendar_features(df, "thirtymins")
    return summary_rollup(timed, [*area, period], ["sum", "count"]).withColumnRenamed(
        "mean", "PM2.5"
    )
