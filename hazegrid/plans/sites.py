"""Regulatory and self-reported networks: readings, site tables, daily tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import schemas
from hazegrid.functions import geometry as G
from hazegrid.functions.calendar import calendar_features, join_date_and_time
from hazegrid.functions.clean import cast_present, fill_parent, parse_point
from hazegrid.functions.levels import level_flags
from hazegrid.functions.names import named
from hazegrid.operators.aggregates import site_profile, summary_with_shares
from hazegrid.operators.filters import date_floor, zscore_filter
from hazegrid.operators.joins import attach_parent_name, outdoor_only
from hazegrid.operators.quantiles import MEDIAN, not_null
from hazegrid.session import materialize

# Columns of the regulatory feed that are codes, not numbers.
EPA_TEXT = (
    "state_code",
    "county_code",
    "site_number",
    "parameter_code",
    "poc",
    "units_of_measure_code",
    "sample_duration_code",
    "detection_limit",
    "method_code",
    "cbsa_code",
    "code",
)
EPA_NUMBERS = ("shape_area", "shape_len")
EPA_KEPT = (
    "site_number",
    "parameter_code",
    "latitude",
    "longitude",
    "sample_measurement",
    "sample_duration",
    "sample_frequency",
    "method_type",
    "value_represented",
    "Full Date",
)
PM = "PM2.5 (ATM)"
PURPLEAIR_KEPT = ("address", "lat", "lon", "ID", "ParentID", PM, "PM2.5 (CF=1)", "created_at")


def epa_typed(raw: DataFrame) -> DataFrame:
    typed = cast_present(cast_present(raw, EPA_TEXT, "string"), EPA_NUMBERS, "double")
    return typed.withColumn(
        "Full Date", join_date_and_time(F.col("date_local"), F.col("time_local"))
    )


def epa_sites(typed: DataFrame) -> DataFrame:
    """Site profile with the sensor's square."""
    profile = site_profile(typed, schemas.EPA_SITE_KEYS, "sample_measurement", "Full Date")
    return profile.withColumn("envelope", G.site_box(F.col("longitude"), F.col("latitude")))


def process_epa(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw regulatory records to (slim readings, site table)."""
    typed = epa_typed(raw)
    return typed.select(*map(named, EPA_KEPT)), epa_sites(typed)


def epa_daily(readings: DataFrame, quantiles: Mapping[str, float] = MEDIAN) -> DataFrame:
    """Per day and station: value statistics and reading shares.

    Stations are not joined to the site table: it has several rows per station
    and would repeat readings, and none of its columns is used here.
    """
    timed = readings.withColumn("Full Date", F.to_timestamp_ntz("Full Date"))
    flagged = level_flags(
        calendar_features(timed, "Full Date"), "sample_measurement", "sample_measurement"
    )
    return summary_with_shares(
        flagged,
        ["Daily", "value_represented", "latitude", "longitude"],
        value="sample_measurement",
        quantiles=quantiles,
    )


def purpleair_typed(raw: DataFrame) -> DataFrame:
    lat, lon = parse_point(F.col("location"))
    located = raw.withColumns({"lat": lat, "lon": lon})
    typed = fill_parent(located, "ID", "ParentID", "device_loc")
    return cast_present(cast_present(typed, ["primaryID"], "string"), [PM], "double")


def purpleair_sites(typed: DataFrame) -> DataFrame:
    """Site profile with the parent's address and the sensor's square."""
    profile = site_profile(typed, schemas.PURPLEAIR_SITE_KEYS, PM, "created_at")
    family = attach_parent_name(profile, "ID", "ParentID", "address", "std_address")
    return family.withColumn("envelope", G.site_box(F.col("lon"), F.col("lat")))


def process_purpleair(
    raw: DataFrame, sites: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw channel rows to (outdoor readings without outliers, site table).

    Pass a written ``sites`` table to avoid profiling the readings again.
    """
    typed = purpleair_typed(raw)
    sites = purpleair_sites(typed) if sites is None else sites
    # Which site is outdoors does not need the statistics: distinct keys will do.
    keyed = typed.where(not_null(schemas.PURPLEAIR_SITE_KEYS))
    places = materialize(keyed.where("device_loc = 'outside'").select("address", "ID", "device_loc").distinct())
    # Written: mean and deviation are taken from these rows before they are filtered by them.
    outdoor = materialize(outdoor_only(typed.select(*map(named, PURPLEAIR_KEPT)), places), "outdoor")
    return zscore_filter(outdoor, [PM]), sites


def purpleair_daily(
    readings: DataFrame, first_day: str = "2017-10-01", quantiles: Mapping[str, float] = MEDIAN
) -> DataFrame:
    """Per day and address: value statistics and shares, from ``first_day`` on."""
    timed = readings.withColumn(
        "created_at", F.to_timestamp_ntz(F.trim(F.translate("created_at", "TZ", "  ")))
    )
    kept = date_floor(calendar_features(timed, "created_at"), "Daily", first_day)
    flagged = level_flags(kept, PM, PM)
    return summary_with_shares(flagged, ["Daily", "address", "lat", "lon"], value=PM, quantiles=quantiles)


def distinct_stations(sites: DataFrame, keys: list[str]) -> DataFrame:
    """One row per station and square."""
    return sites.select(*keys, F.col("envelope").alias("box")).distinct()

