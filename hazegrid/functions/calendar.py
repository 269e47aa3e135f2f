"""Calendar columns and time flooring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR = ("Hourly", "Daily", "Monthly", "MonthYear", "Yearly")


def calendar_features(
    df: DataFrame,
    time: str,
    hourly: bool = True,
    daily: bool = True,
    monthly: bool = True,
    yearly: bool = True,
) -> DataFrame:
    """Add Hourly 0-23, Daily, Monthly 1-12, MonthYear (first of month) and Yearly."""
    t = F.col(time)
    added: dict[str, Column] = {}
    if hourly:
        added["Hourly"] = F.hour(t)
    if daily:
        added["Daily"] = F.to_date(t)
    if monthly:
        added["Monthly"] = F.month(t)
        added["MonthYear"] = F.trunc(F.to_date(t), "MM")
    if yearly:
        added["Yearly"] = F.year(t)
    return df.withColumns(added)


def floor_half_hour(time: Column) -> Column:
    """Start of the half hour; keeps TIMESTAMP_NTZ and keeps null rows."""
    past = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(time) % 30, F.extract(F.lit("SECOND"), time)
    )
    return time - past


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to TIMESTAMP_NTZ; an ISO ``T`` separator is accepted."""
    return df.withColumns(
        {c: F.to_timestamp_ntz(F.regexp_replace(F.col(c), "T", " ")) for c in columns}
    )


def join_date_and_time(date: Column, time: Column) -> Column:
    """``date + ' ' + time``; null when either part is null."""
    return F.concat(date, F.lit(" "), time)


def calendar_to_text(df: DataFrame, columns: list[str], dates: list[str] = ()) -> DataFrame:
    """Calendar columns as text; ``dates`` as ``yyyy-MM-dd``."""
    out = {c: F.col(c).cast("string") for c in columns}
    out.update({c: F.date_format(F.col(c), "yyyy-MM-dd") for c in dates})
    return df.withColumns(out)
