"""Row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named
from hazegrid.functions.rounding import half_even


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def category_filter(df: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose value is listed, for every column named."""
    require_columns(df, wanted)
    return df.where(_every(named(c).isin(list(v)) for c, v in wanted.items()))


def range_filter(df: DataFrame, ranges: Mapping[str, Sequence]) -> DataFrame:
    """Rows inside every range, both ends included."""
    require_columns(df, ranges)
    return df.where(_every(named(c).between(lo, hi) for c, (lo, hi) in ranges.items()))


def date_cutoff(df: DataFrame, time: str, cutoff: str, inclusive: bool = True) -> DataFrame:
    """Rows up to midnight of ``cutoff`` (``yyyy-MM-dd``)."""
    limit = F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd"))
    return df.where(F.col(time) <= limit if inclusive else F.col(time) < limit)


def date_floor(df: DataFrame, day: str, first: str = "2017-10-01") -> DataFrame:
    return df.where(F.col(day) >= F.to_date(F.lit(first)))


def bbox_filter(
    df: DataFrame, lon: str, lat: str, xmin: float, ymin: float, xmax: float, ymax: float
) -> DataFrame:
    """Rows inside the box, edges included; a missing or zero coordinate is unknown."""
    x, y = F.col(lon), F.col(lat)
    return df.where(x.between(xmin, xmax) & y.between(ymin, ymax) & (x != 0) & (y != 0))


def season_filter(
    df: DataFrame,
    day: str,
    months: Sequence[int] = (4, 5, 6, 7, 8, 9),
    after_year: int = 2017,
    year: int | None = None,
) -> DataFrame:
    """Rows of the given months in years after ``after_year`` (or in one year).

    Years are compared as dates, which the file scan can use to skip row groups.
    """
    d = F.col(day)
    keep = F.month(d).isin(list(months)) & (d >= F.lit(dt.date(after_year + 1, 1, 1)))
    if year is not None:
        keep = keep & (d >= F.lit(dt.date(year, 1, 1))) & (d < F.lit(dt.date(year + 1, 1, 1)))
    return df.where(keep)


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(_every(named(c).isNotNull() for c in columns or df.columns))


def min_support(df: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """Rows whose columns all reach their minimum."""
    require_columns(df, thresholds)
    return df.where(_every(F.col(c) >= n for c, n in thresholds.items()))


def _centre_and_spread(df: DataFrame, columns: Sequence[str]) -> Column:
    """One struct with mean and population deviation of every column."""
    return df.agg(
        F.struct(
            *[F.avg(named(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(named(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        )
    ).scalar()


def _is_inlier(stats: Column, columns: Sequence[str], limit: float) -> Column:
    return _every(
        F.abs(F.try_divide(named(c) - stats.getField(f"m{i}"), stats.getField(f"s{i}"))) < limit
        for i, c in enumerate(columns)
    )


def zscore_filter(df: DataFrame, columns: Sequence[str], limit: float = 4.0) -> DataFrame:
    """Drop rows null in any column, then keep |z| < limit in all of them.

    Mean and population deviation are over the whole batch. A constant column has
    no z-score, so nothing is kept.
    """
    require_columns(df, columns)
    full = drop_any_null(df, columns)
    return full.where(_is_inlier(_centre_and_spread(full, columns), columns, limit))


def zscore_report(df: DataFrame, columns: Sequence[str], limit: float = 4.0) -> DataFrame:
    """What ``zscore_filter`` removes: counts and percentages, one row."""
    full = _every(named(c).isNotNull() for c in columns)
    stats = _centre_and_spread(df.where(full), columns)
    inlier = full & F.coalesce(_is_inlier(stats, columns, limit), F.lit(False))
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(_every(named(c).isNull() for c in columns)).alias("n_all_null"),
        F.count_if(full).alias("n_not_null"),
        F.count_if(inlier).alias("n_kept"),
    )
    n, kept, complete = F.col("n_rows"), F.col("n_kept"), F.col("n_not_null")
    return counted.select(
        "*",
        (complete - kept).alias("n_outliers"),
        half_even(F.try_divide(F.col("n_all_null") * 100.0, n), 3).alias("pct_null"),
        half_even((1 - F.try_divide(kept.cast("double"), complete)) * 100, 3).alias("pct_outliers"),
        half_even(F.try_divide(kept * 100.0, n), 3).alias("pct_kept"),
    )


def distinct_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.distinct()
