"""Rollups, threshold shares and grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.geometry import centroid
from hazegrid.functions.levels import is_harmful, is_low
from hazegrid.functions.names import named
from hazegrid.functions.rounding import half_even, settled
from hazegrid.operators.dictionary import Dictionary
from hazegrid.operators.filters import require_columns
from hazegrid.operators.quantiles import MEDIAN, grouped_stats, not_null


def summary_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """median, mean, max, sum and row count of one value column per group."""
    require_columns(df, [*keys, value])
    return grouped_stats(df, keys, value)


def _rollup_columns(sums: Sequence[str], maxes: Sequence[str]) -> list[Column]:
    """Sums, maxima and ``mean`` = first summed column / second summed column."""
    out = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums]
    out += [F.max(m).alias(m) for m in maxes]
    if len(sums) > 1:
        out.append(_ratio(F.sum(sums[0]), F.sum(sums[1])).alias("mean"))
    return out


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom)


def summary_rollup(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str], maxes: Sequence[str] = ()
) -> DataFrame:
    """Roll a summary up: sums add, maxima take the maximum, mean = sum / count."""
    require_columns(df, [*keys, *sums, *maxes])
    return df.where(not_null(keys)).groupBy(*keys).agg(*_rollup_columns(sums, maxes))


def summarize(
    df: DataFrame,
    time_keys: Sequence[str],
    cat_keys: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    value: str | None = None,
) -> DataFrame:
    """Value mode (``value``) or rollup mode (``sums``/``maxes``), exactly one of them."""
    if bool(value) == bool(sums or maxes):
        raise ValueError("pass either a value column or sum/max columns")
    keys = [*time_keys, *cat_keys]
    return summary_values(df, keys, value) if value else summary_rollup(df, keys, sums, maxes)


def _share_parts(harm: str, low: str, weight: Column) -> dict[str, Column]:
    """Weights of all flagged rows, of harmful ones and of low ones."""
    h, n = F.col(harm), F.col(low)
    flagged = h.isNotNull() & n.isNotNull()
    zero = F.lit(0).cast("double")
    return {
        "__flagged": F.when(flagged, weight),
        "__harm": F.when(flagged & (h == 1), weight).otherwise(zero),
        "__low": F.when(flagged & (n == 1), weight).otherwise(zero),
    }


def summary_with_shares(
    df: DataFrame,
    keys: Sequence[str],
    harm: str = "harmful",
    not_harm: str = "not_harmful",
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    value: str | None = None,
    quantiles: Mapping[str, float] = MEDIAN,
) -> DataFrame:
    """Summary per group plus the share of readings whose flag is 1.

    Only readings with both flags count; a group without any has null shares.
    In rollup mode readings are weighted by ``count``. One aggregation, but for the
    ``quantiles`` of value mode; leave them out where nothing reads them.
    """
    require_columns(df, [*keys, harm, not_harm, *sums, *maxes, *([value] if value else [])])
    weight = F.lit(1.0) if value else F.col("count").cast("double")
    parts = _share_parts(harm, not_harm, weight)
    if value:
        out = grouped_stats(
            df, keys, value, quantiles=quantiles, carry={name: ("sum", c) for name, c in parts.items()}
        )
    else:
        out = (
            df.where(not_null(keys))
            .groupBy(*keys)
            .agg(
                *_rollup_columns(sums, maxes),
                *[F.sum(c).alias(name) for name, c in parts.items()],
            )
        )
    return out.withColumns(
        {
            harm: F.try_divide(F.col("__harm"), F.col("__flagged")),
            not_harm: F.try_divide(F.col("__low"), F.col("__flagged")),
        }
    ).drop(*parts)


def rollup_with_cell_shares(
    df: DataFrame,
    keys: Sequence[str],
    cell: str,
    harm: str = "harmful",
    not_harm: str = "not_harmful",
    sums: Sequence[str] = ("sum", "count"),
    maxes: Sequence[str] = ("max",),
) -> DataFrame:
    """Rollup with reading shares, cell shares and the number of cells.

    Two aggregations: to (keys, cell), where each cell's mean is classified, then
    to keys. ``<harm>_hex``/``<not_harm>_hex`` are shares of classified cells and
    ``hex_ct`` counts cells with data. Rows without a cell still count in the rest.
    """
    per_cell = cell_totals(df, keys, cell, harm, not_harm, sums, maxes)
    return totals_with_cell_shares(per_cell, keys, cell, harm, not_harm, sums, maxes)


def cell_totals(
    df: DataFrame,
    keys: Sequence[str],
    cell: str,
    harm: str = "harmful",
    not_harm: str = "not_harmful",
    sums: Sequence[str] = ("sum", "count"),
    maxes: Sequence[str] = ("max",),
) -> DataFrame:
    """The first of the two: totals, flag weights and mean of each cell."""
    keys = list(keys)
    require_columns(df, [*keys, cell, harm, not_harm, *sums, *maxes])
    parts = _share_parts(harm, not_harm, F.col("count").cast("double"))
    return (
        df.where(not_null(keys))
        .groupBy(*keys, cell)
        .agg(
            *[F.sum(s).alias(s) for s in sums],
            *[F.max(m).alias(m) for m in maxes],
            *[F.sum(c).alias(name) for name, c in parts.items()],
        )
        .withColumn(
            "__mean",
            F.when(F.col(cell).isNotNull(), settled(_ratio(F.col(sums[0]), F.col(sums[1])))),
        )
    )


def totals_with_cell_shares(
    per_cell: DataFrame,
    keys: Sequence[str],
    cell: str,
    harm: str = "harmful",
    not_harm: str = "not_harmful",
    sums: Sequence[str] = ("sum", "count"),
    maxes: Sequence[str] = ("max",),
) -> DataFrame:
    """The second: cells to keys, which may be more than the cells were made for."""
    classified = F.count("__mean")
    return (
        per_cell.groupBy(*keys)
        .agg(
            *_rollup_columns(sums, maxes),
            F.try_divide(F.sum("__harm"), F.sum("__flagged")).alias(harm),
            F.try_divide(F.sum("__low"), F.sum("__flagged")).alias(not_harm),
            F.try_divide(F.sum(is_harmful(F.col("__mean"))), classified).alias(f"{harm}_hex"),
            F.try_divide(F.sum(is_low(F.col("__mean"))), classified).alias(f"{not_harm}_hex"),
            F.count(cell).alias("hex_ct"),
        )
    )


def harmful_share(
    df: DataFrame,
    keys: Sequence[str],
    harm: str = "harmful",
    not_harm: str = "not_harmful",
    weight: str | None = None,
) -> DataFrame:
    """Shares only: harmful and low weight over the weight of flagged rows."""
    parts = _share_parts(
        harm, not_harm, F.col(weight).cast("double") if weight else F.lit(1.0)
    )
    return (
        df.where(not_null(keys))
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(name) for name, c in parts.items()])
        .select(
            *keys,
            F.try_divide("__harm", "__flagged").alias(harm),
            F.try_divide("__low", "__flagged").alias(not_harm),
        )
    )


def weighted_share(df: DataFrame, keys: Sequence[str], share: str, name: str) -> DataFrame:
    """Reading-weighted mean of a share that is already a fraction per row."""
    return (
        df.where(not_null(keys))
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum(F.col(share) * F.col("count")),
                F.sum(F.when(F.col(share).isNotNull(), F.col("count"))),
            ).alias(name)
        )
    )


def distinct_cell_count(df: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    return df.where(not_null(keys)).groupBy(*keys).agg(F.count_distinct(cell).alias("hex_ct"))


def cell_stats(
    df: DataFrame,
    cell: str | Sequence[str],
    time: str,
    value: str,
    flags: Sequence[str] = ("harmful", "not_harmful"),
    quantiles: Mapping[str, float] = MEDIAN,
) -> DataFrame:
    """median, mean, max, min, sum, count per cell x half hour x flags."""
    cells = [cell] if isinstance(cell, str) else list(cell)
    return grouped_stats(
        df, [*cells, time, *flags], value, ("mean", "max", "min", "sum", "count"), quantiles
    )


def site_profile(df: DataFrame, keys: Sequence[str], value: str, seen: str) -> DataFrame:
    """Value statistics and first/last seen text per site, columns ``name|stat``."""
    seen_col = named(seen)
    carry = {f"{seen}|min": ("min", seen_col), f"{seen}|max": ("max", seen_col)}
    return grouped_stats(df, keys, value, carry=carry).withColumnsRenamed(
        {s: f"{value}|{s}" for s in ("median", "mean", "max", "sum", "count")}
    )


def group_mean_median(df: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """median, mean and distance of the group mean from the overall mean."""
    require_columns(df, [*keys, feature])
    overall = df.agg(F.avg(feature)).scalar()
    return grouped_stats(df, keys, feature, stats=("mean",)).withColumn(
        "diff_from_group_mean", F.col("mean") - overall
    )


#: Outcomes that may become columns without being listed.
MOST_COLUMNS = 1000


def group_rates(
    df: DataFrame, keys: Sequence[str], feature: str, outcomes: Sequence | None = None
) -> DataFrame:
    """Share of each of the listed outcomes within its group, one column per outcome, 0 if absent.

    Without a list, the outcomes are those of the table; more than ``MOST_COLUMNS`` of them
    are an error and never reach the driver. Rows with a null or another outcome stay in the denominator, as rows of the group.
    ``group_rate_vectors`` and ``group_rates_long`` need no list and take any number of
    outcomes.
    """
    require_columns(df, [*keys, feature])
    if outcomes is None:
        there = df.where(F.col(feature).isNotNull()).select(feature).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(there) > MOST_COLUMNS:
            raise ValueError(f"{feature} has more than {MOST_COLUMNS} outcomes; list them or use group_rate_vectors")
        outcomes = sorted(r[0] for r in there)
    return (
        df.where(not_null(keys))
        .groupBy(*keys)
        .agg(
            *[
                (F.count_if(F.col(feature) == F.lit(o)) / F.count(F.lit(1))).alias(str(o))
                for o in outcomes
            ]
        )
    )


def group_rate_vectors(
    df: DataFrame, keys: Sequence[str], feature: str, known: Dictionary | None = None
) -> tuple[DataFrame, Dictionary]:
    """The same as one sparse vector a group, and the dictionary that numbers its entries.

    ``rates`` is ``struct<size, indices, values>`` with ascending indices. Outcomes are
    those of the table, or of the dictionary ``known``. They are numbered by a join;
    none reaches the driver.
    """
    known = Dictionary.of(df, feature) if known is None else known
    rates = group_rates_long(df, keys, feature).withColumnRenamed("outcome", feature)
    listed = known.attach(rates, "__i")
    entries = F.sort_array(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct(F.col("__i").alias("i"), F.col("rate").alias("v")))))
    # Groups whose outcomes are all null have an empty vector.
    groups = df.where(not_null(keys)).select(*keys).distinct()
    vectors = listed.groupBy(*keys).agg(entries.alias("__e"))
    none = F.array().cast("array<struct<i:bigint,v:double>>")
    entry = F.coalesce("__e", none)
    rate = F.struct(F.lit(known.size).cast("bigint").alias("size"), entry["i"].alias("indices"), entry["v"].alias("values"))
    return groups.join(vectors, list(keys), "left").select(*keys, rate.alias("rates")), known


def group_rates_long(df: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """The same with one row for each outcome that occurs in a group: ``outcome``, ``rate``.

    Rows fold on keys and outcome, so a large group is spread over all tasks.
    """
    require_columns(df, [*keys, feature])
    counts = df.where(not_null(keys)).groupBy(*keys, F.col(feature).alias("outcome")).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    met = counts.where(F.col("outcome").isNotNull()).join(totals, list(keys))
    return met.select(*keys, "outcome", (F.col("__n") / F.col("__all")).alias("rate"))


def bucket_agg(df: DataFrame, keys: Sequence[str], value: str, how: str = "mean") -> DataFrame:
    """``count`` (non-null), ``sum`` or ``mean`` of a feature per bucket."""
    made = {
        "count": F.count(value),
        "sum": F.coalesce(F.sum(value), F.lit(0.0)),
        "mean": F.avg(value),
    }
    if how not in made:
        raise ValueError(f"unknown aggregate {how}")
    return df.where(not_null(keys)).groupBy(*keys).agg(made[how].alias(value))


def bucket_agg_by_grain(
    df: DataFrame, cat: str, grains: Sequence[str], value: str, how: str = "mean"
) -> DataFrame:
    """The same for every category and calendar grain: ``cat, grain, bucket``."""
    long = df.select(
        cat,
        value,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(g).alias("grain"), F.col(g).cast("string").alias("bucket"))
                    for g in grains
                ]
            )
        ).alias("g"),
    ).select(cat, value, "g.grain", "g.bucket")
    return bucket_agg(long, [cat, "grain", "bucket"], value, how)


def neighborhood_summary(df: DataFrame, area: str, time: str) -> DataFrame:
    """Per area: mean = sum/count, periods with data; ascending by mean."""
    return (
        df.where(not_null([area, time]))
        .groupBy(area, time)
        .agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
        .groupBy(area)
        .agg(
            F.sum("sum").alias("sum"),
            F.sum("count").alias("count"),
            F.count(F.lit(1)).alias("timevar_count"),
        )
        .withColumn("mean", _ratio(F.col("sum"), F.col("count")))
        .orderBy(F.asc("mean"), F.asc(area))
    )


def year_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(F.year(time)).alias("first_year"), F.max(F.year(time)).alias("last_year"))


def top_values(df: DataFrame, column: str, n: int | None = 9) -> DataFrame:
    """Most frequent values; ``None`` returns all of them."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )
    return counts if n is None else counts.limit(n)


def map_center_of_shapes(df: DataFrame, rings: str = "rings", holes: str = "holes") -> DataFrame:
    """The same for polygons, by their centroids. Without a column ``holes`` a shape has one part."""
    center = centroid(F.col(rings), F.col(holes) if holes in df.columns else None)
    return map_center(df.select(center["y"].alias("lat"), center["x"].alias("lon")), "lat", "lon")


def map_center(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Median latitude and longitude, four decimals."""
    one = grouped_stats(df, [], lat, stats=(), quantiles={"lat": 0.5})
    two = grouped_stats(df, [], lon, stats=(), quantiles={"lon": 0.5})
    # Two one-row results; put side by side by scalar subquery, not by a join.
    return one.select(
        half_even(F.col("lat"), 4).alias("lat_center"),
        half_even(two.select("lon").scalar(), 4).alias("lon_center"),
    )
