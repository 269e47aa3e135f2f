"""Table profiles and the datasets behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.functions.rounding import half_even
from hazegrid.operators.aggregates import bucket_agg
from hazegrid.operators.filters import require_columns, season_filter
from hazegrid.operators.joins import join_lookup
from hazegrid.operators.quantiles import grouped_stats, not_null
from hazegrid.session import materialize

QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}

KINDS = ("Object", "bool", "Numeric", "DateTime", "Some Other Data Types")


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "Object"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "Numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return "Some Other Data Types"


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long: ids, ``variable``, ``value``."""
    return df.unpivot(list(ids), list(values), "variable", "value")


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: kind, distinct values incl. null, nulls, null share, most frequent.

    Columns are turned into rows and counted by (column, value) first, so neither
    the distinct count nor the most frequent value is held in one task. Of equally
    frequent values the smallest text is named. Complex values profile as JSON text.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        kind = _kind(f.dataType)
        value = F.col(f.name)
        simple = not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(kind).alias("type"),
                F.lit(KINDS.index(kind)).alias("kind_order"),
                (value.cast("string") if simple else F.to_json(value)).alias("value"),
            )
        )
    names = ["position", "column", "type", "kind_order"]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .groupBy(*names, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.col("value").isNotNull()
    best = F.max(F.when(known, F.col("n")))
    # Highest count first, then the smallest text: two mergeable folds, no sort.
    example = F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value"))))
    nulls = F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
    return (
        counts.groupBy(*names)
        .agg(
            F.count(F.lit(1)).alias("unique_values"),
            nulls.alias("na_values"),
            half_even(nulls / F.sum("n"), 2).alias("percent_na"),
            F.when(best.isNotNull(), example).alias("example"),
        )
        .orderBy("kind_order", "position")
        .drop("kind_order", "position")
    )


def numeric_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of numeric columns."""
    require_columns(df, columns)
    long = melt(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    spread = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    cuts = grouped_stats(long, ["variable"], "value", stats=(), quantiles=QUARTILES)
    return spread.join(cuts, "variable")


def single_grain_report(
    df: DataFrame, var: str, grains: Sequence[str] = ("Hourly", "Daily", "Monthly", "Yearly")
) -> DataFrame:
    """Categories having one single value in a calendar grain, and that value.

    A null counts as a value of its own. Counting (category, grain, value) first
    keeps the distinct counts spread out.
    """
    long = df.where(F.col(var).isNotNull()).select(
        F.col(var).cast("string").alias("category"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(g).alias("grain"), F.col(g).cast("string").alias("value"))
                    for g in grains
                ]
            )
        ).alias("g"),
    )
    return (
        long.select("category", "g.grain", "g.value")
        .groupBy("category", "grain", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("category", "grain")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.sum("n").alias("observations"),
            F.max("value").alias("only_value"),
        )
        .where(F.col("distinct") == 1)
        .drop("distinct")
    )


def histogram(
    df: DataFrame, feature: str, by: Sequence[str] = (), bins: int = 50
) -> DataFrame:
    """Equal-width bins from min to max of each group, the last one closed.

    Gives ``bin``, its ``left`` edge, ``count`` and ``density`` (area one).
    """
    by = list(by)
    require_columns(df, [feature, *by])
    rows = df.where(not_null([feature, *by])).select(*by, F.col(feature).cast("double").alias("__x"))
    limits = [F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("__x").alias("__n")]
    if by:
        # Written first, so that it is small when its size is measured for the join.
        ranged = join_lookup(rows, materialize(rows.groupBy(*by).agg(*limits)), by, "inner")
    else:
        found = rows.agg(F.struct(*limits)).scalar()
        ranged = rows.withColumns({c: found.getField(c) for c in ("__lo", "__hi", "__n")})
    lo, hi = F.col("__lo"), F.col("__hi")
    # A constant feature gets a range of one around it.
    flat = lo == hi
    binned = ranged.select(
        *by,
        "__x",
        "__n",
        F.when(flat, lo - 0.5).otherwise(lo).alias("__start"),
        (F.when(flat, 1.0).otherwise(hi - lo) / bins).alias("__width"),
    ).withColumn(
        "bin", F.expr(f"cast(least(floor((__x - __start) / __width), {bins - 1}) AS int)")
    )
    # Only counts per bin are shuffled; the range is the same in all rows of a group.
    return (
        binned.groupBy(*by, "bin", "__start", "__width", "__n")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *by,
            "bin",
            (F.col("__start") + F.col("bin") * F.col("__width")).alias("left"),
            "count",
            (F.col("count") / (F.col("__n") * F.col("__width"))).alias("density"),
        )
    )


#: Bandwidths beyond which a Gaussian is below the last digit of its peak.
KERNEL_REACH = 9.0


def density_curve(df: DataFrame, feature: str, points: int = 128) -> DataFrame:
    """Gaussian kernel density at equally spaced points, Scott's bandwidth.

    The grid reaches three bandwidths beyond the data. Readings fold to distinct
    values with counts. A value only meets the grid points within ``KERNEL_REACH``
    bandwidths, beyond which a double has nothing left of it; the more readings, the
    narrower the bandwidth and the fewer points. Sums per grid point combine map-side.
    """
    values = (
        df.where(F.col(feature).isNotNull())
        .groupBy(F.col(feature).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    spread = df.agg(
        F.struct(
            F.count(feature).cast("double").alias("n"),
            F.stddev_samp(feature).alias("sd"),
            F.min(feature).cast("double").alias("lo"),
            F.max(feature).cast("double").alias("hi"),
        )
    ).scalar()
    set_up = values.withColumn("s", spread).select(
        "x",
        "c",
        F.col("s.n").alias("n"),
        (F.col("s.sd") * F.pow(F.col("s.n"), F.lit(-0.2))).alias("h"),
        F.col("s.lo").alias("lo"),
        F.col("s.hi").alias("hi"),
    )
    lo, hi, h = F.col("lo") - 3 * F.col("h"), F.col("hi") + 3 * F.col("h"), F.col("h")
    at = lo + (hi - lo) * F.col("point") / (points - 1)
    step = (hi - lo) / (points - 1)
    first = F.greatest(F.floor((F.col("x") - lo - KERNEL_REACH * h) / step), F.lit(0))
    last = F.least(F.ceil((F.col("x") - lo + KERNEL_REACH * h) / step), F.lit(points - 1))
    z = (at - F.col("x")) / h
    kernel = F.exp(z * z * -0.5) * F.col("c") / (h * F.col("n") * F.sqrt(F.lit(2.0) * F.pi()))
    sums = (
        set_up.withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .groupBy("point")
        .agg(F.sum(kernel).alias("density"))
    )
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).withColumn("s", spread)
    placed = grid.select(
        "point",
        F.col("s.lo").alias("lo"),
        F.col("s.hi").alias("hi"),
        (F.col("s.sd") * F.pow(F.col("s.n"), F.lit(-0.2))).alias("h"),
    ).where("h IS NOT NULL")
    return placed.join(sums, "point", "left").select(
        "point", at.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density")
    )


def before_after(
    original: DataFrame, cleaned: DataFrame, features: Sequence[str], time: str, bins: int = 50
) -> tuple[DataFrame, DataFrame]:
    """Histogram and time series of each feature, original and cleaned.

    Both come out long: ``stage``, ``variable``, then bins or time points.
    """
    long = [
        melt(df.select(time, *features), [time], features).withColumn("stage", F.lit(stage))
        for stage, df in (("original", original), ("removed_outliers", cleaned))
    ]
    both = long[0].unionByName(long[1])
    keys = ["stage", "variable"]
    return histogram(both, "value", keys, bins), bucket_agg(both, [*keys, time], "value", "mean")


def correlation_matrix(
    df: DataFrame, features: Sequence[str], hue: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every pair, ``a, b, corr`` (per hue), in one aggregation."""
    pairs = list(combinations(features, 2))
    both = {p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() for p in pairs}
    wide = df.where(not_null(hue)).groupBy(*hue).agg(
        *[
            F.corr(F.when(both[p], F.col(p[0])), F.when(both[p], F.col(p[1]))).alias(f"__{i}")
            for i, p in enumerate(pairs)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*hue, F.explode(rows).alias("p")).select(*hue, "p.*")


def linear_fit(df: DataFrame, x: str, y: str, hue: Sequence[str] = ()) -> DataFrame:
    """Least squares line, Pearson r and the common axis range (per hue).

    Slope and intercept to one decimal, r to three. The axis range spans all
    values of both columns, the fit uses rows where both are known.
    """
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    both = fx.isNotNull() & fy.isNotNull()
    cx, cy = F.when(both, fx), F.when(both, fy)
    return df.where(not_null(hue)).groupBy(*hue).agg(
        half_even(F.regr_slope(fy, fx), 1).alias("slope"),
        half_even(F.regr_intercept(fy, fx), 1).alias("intercept"),
        half_even(F.corr(cx, cy), 3).alias("corr"),
        F.least(F.min(fx), F.min(fy)).alias("axis_min"),
        F.greatest(F.max(fx), F.max(fy)).alias("axis_max"),
    )


def two_axis_series(
    df: DataFrame, time: str, first: Sequence[str], second: Sequence[str] = ()
) -> DataFrame:
    """Mean of each series per time point, tagged with its axis (1 or 2)."""
    series = [*first, *second]
    long = melt(df.select(time, *[F.col(c).cast("double").alias(c) for c in series]), [time], series)
    axis = F.when(F.col("variable").isin(list(second)), 2).otherwise(1)
    return (
        long.where(not_null([time]))
        .groupBy(time, "variable")
        .agg(F.avg("value").alias("value"))
        .select(time, axis.alias("axis"), F.col("variable").alias("series"), "value")
    )


def five_number_summary(
    df: DataFrame, sources: Sequence[str], year: str | None = None
) -> DataFrame:
    """Min, quartiles and max per source; with ``year`` also per year (``All`` = all)."""
    ids = [year] if year else []
    long = melt(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in sources]), ids, sources)
    if not year:
        return grouped_stats(long, ["variable"], "value", stats=(), quantiles=QUARTILES)
    label = F.explode(F.array(F.col(year).cast("string"), F.lit("All"))).alias("year")
    return grouped_stats(
        long.select(label, "variable", "value"),
        ["year", "variable"],
        "value",
        stats=(),
        quantiles=QUARTILES,
    )


def heatmap_matrix(
    df: DataFrame,
    day: str,
    columns: Sequence[str],
    months: Sequence[int] = (4, 5, 6, 7, 8, 9),
    after_year: int = 2017,
    upper: float | None = None,
) -> DataFrame:
    """Day x source matrix with color limits shared by all years.

    ``upper`` fixes the upper limit (0.1 for harmful shares).
    """
    rows = season_filter(df.na.drop("any"), day, months, after_year).select(day, *columns)
    low = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    top = F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    limits = rows.agg(F.struct(low.alias("vmin"), top.alias("vmax"))).scalar()
    high: Column = F.lit(upper) if upper is not None else limits.getField("vmax")
    return rows.withColumns(
        {"year": F.year(day), "vmin": limits.getField("vmin"), "vmax": high}
    )
