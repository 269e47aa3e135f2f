"""Incremental refresh: drop the possibly incomplete tail, load it again, publish.

``incremental_refresh`` writes a new version of the tables and leaves the former
one alone. ``refresh_partitions`` is for tables partitioned by day that are too
large to be rewritten: only the days of the window are replaced. Repeating either one
changes nothing, and both keep what lies after the window.

``network_tables`` builds the nine tables of the networks from raw records of a window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators.joins import append_rows
from hazegrid.plans import community, sites
from hazegrid.sources.tables import replace_partitions, write_partitioned

# Earliest watermark, and how far behind today a load ends.
FLOOR = dt.datetime(2016, 1, 1)
LAG_DAYS = 14
#: Tables that are written at the same time.
AT_ONCE = 3


def refresh_watermark(
    tables: Mapping[str, tuple[DataFrame, str]], neighborhoods: DataFrame | None = None
) -> DataFrame:
    """Earliest of the tables' latest times, as a date (one row).

    ``tables`` gives each table with its time column. The neighborhood table
    counts with its latest time, but no earlier than the floor.
    """
    latest = [
        df.agg(F.max(F.col(c).cast("timestamp_ntz")).alias("latest")) for df, c in tables.values()
    ]
    if neighborhoods is not None:
        floor = F.lit(FLOOR).cast("timestamp_ntz")
        newest = F.max(F.col("thirtymins").cast("timestamp_ntz"))
        latest.append(neighborhoods.agg(F.greatest(newest, floor).alias("latest")))
    union = latest[0]
    for df in latest[1:]:
        union = union.unionByName(df)
    return union.agg(F.to_date(F.min("latest")).alias("last_updated"))


def load_window(
    last_updated: dt.date, end: dt.date | None = None, lag_days: int = LAG_DAYS
) -> tuple[dt.date, dt.date]:
    """Half-open ``[start, end)`` of the days to load, the same for all sources."""
    return last_updated, end or dt.date.today() - dt.timedelta(days=lag_days)


def refreshed(
    current: DataFrame, time: str, new: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Rows of ``[start, end)`` from the new load, all others as they are.

    Without a window (``end`` at or before ``start``) nothing changes. Rows without a
    time stay.
    """
    if end <= start:
        return current
    at = F.col(time)
    kept = at.isNull() | (at < F.lit(start)) | (at >= F.lit(end))
    return append_rows(current.where(kept), _window(new, time, start, end))


def _window(df: DataFrame, time: str, start: dt.date, end: dt.date) -> DataFrame:
    return df.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def incremental_refresh(
    spark: SparkSession,
    current: Mapping[str, tuple[DataFrame, str]],
    load: Callable[[dt.date, dt.date], Mapping[str, DataFrame]],
    out: str,
    end: dt.date | None = None,
    partition: Mapping[str, str] | None = None,
    neighborhoods: str | None = None,
    profiles: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Refresh all tables and write the new version below ``out``.

    ``load(start, end)`` returns the aggregated tables of the window.
    ``neighborhoods`` names the table whose watermark is no earlier than the floor.
    ``profiles`` are tables without a time, which the load replaces as a whole when it
    has a window. Running it twice gives the same rows as running it once.
    """
    others = {n: t for n, t in current.items() if n != neighborhoods}
    row = refresh_watermark(others, current[neighborhoods][0] if neighborhoods else None).first()
    start, stop = load_window(row["last_updated"] or FLOOR.date(), end)
    fresh = load(start, stop) if stop > start else {}
    versions = {n: refreshed(df, time, fresh.get(n, df), start, stop) for n, (df, time) in current.items()}
    versions |= {n: fresh.get(n, df) for n, df in (profiles or {}).items()}

    def write(name: str) -> None:
        if partition and name in partition:
            write_partitioned(versions[name], f"{out}/{name}", partition[name], "overwrite")
        else:
            versions[name].write.mode("overwrite").parquet(f"{out}/{name}")

    # Tables do not depend on each other: one's last tasks leave room for the next one's first.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(write, versions))
    return {name: spark.read.parquet(f"{out}/{name}") for name in versions}


def refresh_partitions(
    spark: SparkSession,
    paths: Mapping[str, str],
    load: Callable[[dt.date, dt.date], Mapping[str, DataFrame]],
    end: dt.date | None = None,
    day: str = "Daily",
) -> dict[str, DataFrame]:
    """Refresh tables partitioned by ``day`` in place, replacing the days of the window.

    A day that the load has no rows for loses those it had. A table's days are published
    when all of them are written, each by renaming its folder.
    """
    current = {name: (spark.read.parquet(path), day) for name, path in paths.items()}
    row = refresh_watermark(current).first()
    start, stop = load_window(row["last_updated"] or FLOOR.date(), end)
    if stop > start:
        fresh = load(start, stop)

        def replace(name: str) -> None:
            had = _window(current[name][0], day, start, stop).select(day).distinct()
            # At most the days of the window. Those that the load has rows for are replaced all the same.
            gone = [r[0] for r in had.collect()]
            replace_partitions(_window(fresh[name], day, start, stop), paths[name], day, gone)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(replace, paths))
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def network_tables(
    epa_raw: DataFrame, purpleair_raw: DataFrame, tagged: DataFrame, first_day: str = "2017-10-01"
) -> dict[str, DataFrame]:
    """The nine tables made from a window's raw records and geotagged points."""
    epa, epa_sites = sites.process_epa(epa_raw)
    purpleair, purpleair_sites = sites.process_purpleair(purpleair_raw)
    cells = community.process_points(tagged)
    return {
        "epa_daily": sites.epa_daily(epa),
        "epa_sites": epa_sites,
        "purpleair_daily": sites.purpleair_daily(purpleair, first_day),
        "purpleair_sites": purpleair_sites,
        **{f"aq_by_{grain}": df for grain, df in cells.items()},
        "neighborhoods": community.neighborhood_table(tagged),
    }


#: Time column of each table of ``network_tables``; the site profiles have none.
TIMES = {
    "epa_daily": "Daily",
    "purpleair_daily": "Daily",
    "aq_by_block": "thirtymins",
    "aq_by_neighborhood": "thirtymins",
    "aq_by_hexagon": "thirtymins",
    "aq_by_big_hexagon": "thirtymins",
    "neighborhoods": "thirtymins",
}
PROFILES = ("epa_sites", "purpleair_sites")
