"""Attribute joins. A side is broadcast only when the planner's size estimate allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named

#: Estimated bytes up to which a side is broadcast. Files take a few times as much in memory.
MAX_BYTES = 16 * 1024 * 1024


def fits_in_memory(df: DataFrame, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the planner's estimate of a table is small; starts no job.

    The estimate of a scan is the size of its files; filters, aggregates and joins
    never raise it above their inputs' product. A table that only turns out to be
    small is still broadcast by adaptive execution, from its measured size.
    """
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= max_bytes


def join_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    condition=None,
    broadcast: bool | None = None,
    grown: int = 1,
) -> DataFrame:
    """Join a large table to a lookup table on equal column names.

    A small lookup is broadcast, so the large side does not move; ``broadcast``
    overrides the estimate, and ``grown`` says how many times larger the rows are than
    those that the estimate knows (after an explode). Any other lookup is joined by a
    shuffle, where adaptive execution splits the partitions of hot keys and sends the
    matching part of the lookup to each piece. Null keys match nothing. ``condition``
    refines the match (its columns must be distinct from each other).
    """
    on = list(on)
    small = fits_in_memory(lookup, MAX_BYTES // grown) if broadcast is None else broadcast
    renamed = lookup.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & (named(c) == named(f"__r_{c}"))
    if condition is not None:
        match = match & condition
    return fact.join(F.broadcast(renamed) if small else renamed, match, how).drop(*[f"__r_{c}" for c in on])


def left_join_sites(
    readings: DataFrame, sites: DataFrame, reading_key: str, site_key: str
) -> DataFrame:
    """Site attributes onto readings by differently named keys.

    Columns present on both sides get ``_left`` / ``_right``.
    """
    both = set(readings.columns) & set(sites.columns)
    left = readings.withColumnsRenamed({c: f"{c}_left" for c in both})
    right = sites.withColumnsRenamed({c: f"{c}_right" for c in both})
    lkey = f"{reading_key}_left" if reading_key in both else reading_key
    rkey = f"{site_key}_right" if site_key in both else site_key
    keyed = right.withColumn("__key", F.col(rkey))
    return join_lookup(left.withColumn("__key", F.col(lkey)), keyed, ["__key"]).drop("__key")


def attach_parent_name(
    sites: DataFrame, id_col: str, parent_col: str, name_col: str, out: str
) -> DataFrame:
    """Name of the parent row (``id == parent``) onto every row of the family."""
    parents = (
        sites.where(F.col(id_col) == F.col(parent_col))
        .select(F.col(parent_col), F.col(name_col).alias(out))
        .distinct()
    )
    return sites.join(parents, parent_col, "left")


def semi_join(fact: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return join_lookup(fact, ids.select(*on).distinct(), on, "left_semi")


def outdoor_only(
    readings: DataFrame,
    sites: DataFrame,
    address: str = "address",
    id_col: str = "ID",
    parent: str = "ParentID",
    place: str = "device_loc",
) -> DataFrame:
    """Readings at an outdoor site's address, or whose parent is an outdoor site."""
    outdoor = sites.where(F.col(place) == "outside")
    spots = outdoor.select(address).distinct().withColumn("__spot", F.lit(True))
    devices = (
        outdoor.select(F.col(id_col).alias(parent)).distinct().withColumn("__device", F.lit(True))
    )
    flagged = join_lookup(join_lookup(readings, spots, [address]), devices, [parent])
    keep = F.col("__spot").isNotNull() | F.col("__device").isNotNull()
    return flagged.where(keep).drop("__spot", "__device")


def combine_sources(
    aq: DataFrame, epa: DataFrame, pa: DataFrame, day: str = "Daily"
) -> DataFrame:
    """Three daily tables side by side, left-joined on the day.

    Value columns are prefixed AQ_, EPA_, PA_; columns only the first table has
    (cell shares, cell count) keep their names. Each side has one row per day.
    """
    shared = (set(epa.columns) | set(pa.columns)) - {day}

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c in shared})

    return (
        prefixed(aq, "AQ")
        .join(prefixed(epa, "EPA"), day, "left")
        .join(prefixed(pa, "PA"), day, "left")
    )


def append_rows(current: DataFrame, new: DataFrame) -> DataFrame:
    """Union all by column name; columns missing on a side are null."""
    return current.unionByName(new, allowMissingColumns=True)


def with_all_bucket(df: DataFrame, columns: Sequence[str], label: str = "All") -> DataFrame:
    """Every row as it is and once more with the columns set to ``label``; distinct."""
    real = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    total = F.struct(*[F.lit(label).alias(c) for c in columns])
    rest = [named(c) for c in df.columns if c not in columns]
    return (
        df.withColumn("__b", F.explode(F.array(real, total)))
        .select(*rest, *[F.col(f"__b.{c}").alias(c) for c in columns])
        .distinct()
    )
