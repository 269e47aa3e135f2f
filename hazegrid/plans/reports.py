"""The dashboard's selection: which prepared tables a choice of filters shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.filters import season_filter
from hazegrid.operators.profiling import (
    five_number_summary,
    heatmap_matrix,
    linear_fit,
    two_axis_series,
)

MEANS = {"EPA": "EPA_mean", "AQ": "AQ_mean", "PA": "PA_mean"}


def report_dataset(
    combined: Mapping[str, DataFrame],
    year: int | None = None,
    month: int | None = None,
    neighborhood: str | None = None,
    two_miles: bool = False,
    heatmaps: bool = True,
    timeseries: bool = True,
    scatters: bool = True,
    boxplots: bool = True,
    all_years: bool = True,
    months: tuple[int, ...] = (4, 5, 6, 7, 8, 9),
    after_year: int = 2017,
    maps: Mapping[str, DataFrame] | None = None,
    areas: Mapping[str, DataFrame] | None = None,
    summary: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Datasets by name for one selection.

    ``combined`` holds the comparison tables ``aq``, ``near_epa`` and ``near_pa``;
    ``maps`` the monthly layers (with year and month), ``areas`` the neighborhood
    tables (with ``pri_neigh``). Charts need a year; the two-mile switch compares
    each network with the hexagons near its own sensors only.
    """
    if two_miles:
        shown = {"near_epa": ("EPA", "AQ"), "near_pa": ("PA", "AQ")}
    else:
        shown = {"aq": ("EPA", "AQ", "PA")}
    out: dict[str, DataFrame] = {}
    for name, networks in shown.items():
        table = combined[name].na.drop("any")
        season = season_filter(table, "Daily", months, after_year)
        means = [MEANS[n] for n in networks]
        others = [n for n in networks if n != "AQ"]
        if year is not None:
            one_year = season.where(F.year("Daily") == year)
            if heatmaps:
                for kind, column, upper in (
                    ("mean", "mean", None),
                    ("harmful", "harmful", 0.1),
                    ("low", "not_harmful", None),
                ):
                    matrix = heatmap_matrix(
                        table, "Daily", [f"{n}_{column}" for n in networks], months, after_year, upper
                    )
                    out[f"{name}/heatmap_{kind}"] = matrix.where(F.col("year") == year)
            if timeseries:
                out[f"{name}/timeseries"] = two_axis_series(one_year, "Daily", means)
            if scatters:
                for n in others:
                    out[f"{name}/scatter_{n}"] = linear_fit(one_year, "AQ_mean", f"{n}_mean")
                if boxplots:
                    out[f"{name}/boxplot"] = five_number_summary(one_year, means)
        if all_years or year is None:
            for n in others:
                out[f"{name}/all_years_scatter_{n}"] = linear_fit(
                    season.withColumn("Year", F.year("Daily")), "AQ_mean", f"{n}_mean", ["Year"]
                )
            out[f"{name}/all_years_boxplot"] = five_number_summary(season, means)
    if (all_years or year is None) and summary is not None:
        out["neighborhood_summary"] = summary
    if maps and year is not None and month is not None:
        here = (F.col("year") == year) & (F.col("month") == month)
        out.update({f"map/{layer}": df.where(here) for layer, df in maps.items()})
    if areas and neighborhood is not None:
        mine = F.col("pri_neigh") == neighborhood
        out.update({f"neighborhood/{part}": df.where(mine) for part, df in areas.items()})
    return out
