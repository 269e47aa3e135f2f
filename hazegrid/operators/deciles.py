"""Quantiles put back next to the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.rounding import settled
from hazegrid.operators.joins import join_lookup
from hazegrid.operators.quantiles import grouped_stats
from hazegrid.session import materialize


def attach_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float = 0.9, name: str = "top10"
) -> DataFrame:
    """Per-group quantile (linear interpolation) as a column of every row.

    The rows are written first, since the quantiles and the join both read them.
    Adaptive execution broadcasts the quantiles when they turn out small and splits a
    group with many rows otherwise.
    """
    # The mean and the quantile of the same means come from separate tasks.
    cut = materialize(df.withColumn(value, settled(F.col(value))), "means")
    limits = grouped_stats(cut, keys, value, stats=(), quantiles={name: p})
    return join_lookup(cut, limits, keys)


def top_decile_flag(
    df: DataFrame, keys: Sequence[str], value: str = "mean", name: str = "cat"
) -> DataFrame:
    """``Top 10%`` at or above the group's 0.9 quantile, else ``Low 90%``.

    Rows without a value are in neither class and are dropped.
    """
    tagged = attach_quantile(df.where(F.col(value).isNotNull()), keys, value)
    label = F.when(F.col(value) >= F.col("top10"), "Top 10%").otherwise("Low 90%")
    return tagged.withColumn(name, label).drop("top10")
