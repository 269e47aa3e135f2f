"""Concentration levels: flags, share categories and labelled bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named

# Thresholds and labels published with the sensor networks' reports.
HARMFUL_FROM = 35.0
LOW_UP_TO = 12.0
LEVEL_EDGES = (-0.1, 6.0, 12.0, 22.0, 35.0, 1000.0)
LEVEL_LABELS = ("0-6", "6-12", "12-22", "22-35", "35+")


def is_harmful(value: Column) -> Column:
    """1.0 at or above the harmful level, 0.0 below, null stays null."""
    return (value >= HARMFUL_FROM).cast("double")


def is_low(value: Column) -> Column:
    """1.0 at or below the low level, 0.0 above, null stays null."""
    return (value <= LOW_UP_TO).cast("double")


def level_flags(df: DataFrame, harm: str, not_harm: str) -> DataFrame:
    """Add ``harmful`` and ``not_harmful`` from the two named columns."""
    return df.withColumns(
        {"harmful": is_harmful(named(harm)), "not_harmful": is_low(named(not_harm))}
    )


def share_categories(df: DataFrame, harm: str, no_harm: str) -> DataFrame:
    """Label the two shares; exactly 0.01 (harmful) and 0.02 (low) stay unlabelled."""
    h, low = F.col(harm), F.col(no_harm)
    harmful = (
        F.when((h >= 0) & (h < 0.01), "0-1")
        .when((h > 0.01) & (h < 0.03), "1-3")
        .when((h >= 0.03) & (h < 0.06), "3-6")
        .when((h >= 0.06) & (h < 0.14), "6-14")
        .when(h >= 0.14, "14+")
        .otherwise("")
    )
    lows = (
        F.when((low >= 0) & (low < 0.02), "0-2")
        .when((low > 0.02) & (low < 0.1), "2-10")
        .when((low >= 0.1) & (low < 0.9), "10-90")
        .when((low >= 0.9) & (low < 0.98), "90-98")
        .when(low >= 0.98, "98+")
        .otherwise("")
    )
    return df.withColumns({"harmful_cat": harmful, "low_cat": lows})


def labelled_bins(
    value: Column, edges: Sequence, labels: Sequence | None, right: bool = True
) -> Column:
    """Bin between consecutive edges; outside every bin is null.

    ``edges`` may hold numbers or columns. ``right`` closes bins on the right
    (open on the left), otherwise the other way round. Without labels the bin's
    position is returned.
    """
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = ((value > lo) & (value <= hi)) if right else ((value >= lo) & (value < hi))
        label = F.lit(i if labels is None else labels[i])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def level_bins(value: Column) -> Column:
    return labelled_bins(value, LEVEL_EDGES, LEVEL_LABELS)
