"""Explicit schemas of the files this package reads."""

from __future__ import annotations

EPA_READINGS = (
    "site_number string, parameter_code string, latitude double, longitude double, "
    "sample_measurement double, sample_duration string, sample_frequency string, "
    "method_type string, value_represented string, date_local string, time_local string"
)
EPA_SITE_KEYS = [
    "site_number",
    "value_represented",
    "latitude",
    "longitude",
    "sample_duration",
    "sample_frequency",
    "method_type",
]
PURPLEAIR_SITE_KEYS = [
    "address",
    "lat",
    "lon",
    "name",
    "device_loc",
    "ID",
    "primaryID",
    "ParentID",
    "sensor_created_at",
]
COMMUNITY_POINTS = "id bigint, time string, value double, lat double, lng double"
NEIGHBORHOOD_ROLLUP = (
    "thirtymins timestamp_ntz, geoid10 string, lat_r double, lng_r double, median double, "
    "mean double, max double, sum double, count double"
)
SHAPES = "id bigint, geometry string"
GEOJSON = (
    "features array<struct<properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)
FEED = (
    "channel map<string, string>, feeds array<map<string, string>>, site map<string, string>"
)
