"""Table and document schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

DAILY = "daily"
CONTINUOUS = "continuous"
SERVICES = (DAILY, CONTINUOUS)

DEFAULT_PARAM = "00060"
PARTITION_COLUMNS = ["site_no", "param_cd", "year"]


def check_service(service: str) -> str:
    if service not in SERVICES:
        raise ValueError(f"unknown service {service!r}: expected one of {SERVICES}")
    return service


def datetime_type(service: str) -> T.DataType:
    """A daily value belongs to a local calendar day, a continuous one to an instant."""
    return T.DateType() if check_service(service) == DAILY else T.TimestampType()


def reading_schema(service: str) -> T.StructType:
    """The nine columns of a reading."""
    return T.StructType(
        [
            T.StructField("site_no", T.StringType(), False),
            T.StructField("param_cd", T.StringType(), False),
            T.StructField("datetime", datetime_type(service), False),
            T.StructField("value", T.DoubleType(), False),
            T.StructField("qualifiers", T.StringType(), True),
            T.StructField("latitude", T.DoubleType(), False),
            T.StructField("longitude", T.DoubleType(), False),
            T.StructField("approval_status", T.StringType(), False),
            T.StructField("last_modified", T.TimestampType(), True),
        ]
    )


def stored_schema(service: str) -> T.StructType:
    """What a lake file must hold: the reading without the columns its path gives."""
    fields = [f for f in reading_schema(service) if f.name not in PARTITION_COLUMNS]
    return T.StructType(fields)


def lake_schema(service: str) -> T.StructType:
    """A lake table: stored columns, then the path columns, which are always strings."""
    table = stored_schema(service)
    for name in PARTITION_COLUMNS:
        table = table.add(name, T.StringType(), True)
    return table


# Landed documents must be plain JSON; a reader that meets anything else fails.
STRICT_JSON = {
    "mode": "FAILFAST",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}

# Value and qualifier stay variants, so that the JSON type they arrived with is still known.
READING_PAGE = """
    features array<struct<
        properties struct<
            monitoring_location_id string, parameter_code string, time string,
            value variant, qualifier variant, approval_status string, last_modified string>,
        geometry struct<coordinates array<double>>>>,
    links array<struct<rel string, href string>>
"""

METADATA_PAGE = """
    features array<struct<
        properties struct<
            monitoring_location_id string, monitoring_location_name string,
            state_name string, county_name string, hydrologic_unit_code string,
            drainage_area double, altitude double,
            parameter_code string, parameter_name string, statistic_id string,
            begin string, end string, primary string>>>,
    links array<struct<rel string, href string>>
"""

SITE_METADATA = """
    site_no string, name string, state_name string, county_name string,
    hydrologic_unit_code string, drainage_area double, altitude double,
    series array<struct<
        parameter_code string, parameter_name string, statistic_id string,
        begin string, end string, primary string>>
"""

# Coordinates stay text here: their depth depends on the geometry type.
BASIN_DOCUMENT = """
    features array<struct<geometry struct<type string, coordinates string>>>
"""

MANIFEST = """
    content_hash string, parent_hash string, created_at string, generator string,
    source struct<collection string, sites array<string>, param_cd string,
        start string, end string>,
    upstream_state struct<max_last_modified string,
        approval_status_counts map<string, bigint>>,
    row_count bigint,
    files array<struct<path string, sha256 string, row_count bigint>>
"""
