"""Sites: the list with locations, descriptive metadata, and a readable report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.functions.guards import require
from riverlake.schemas import SERVICES
from riverlake.sources import lake

_SITE_FIELDS = [
    "name",
    "state_name",
    "county_name",
    "hydrologic_unit_code",
    "drainage_area",
    "altitude",
]
_SERIES_FIELDS = [
    "parameter_code",
    "parameter_name",
    "statistic_id",
    "begin",
    "end",
    "primary",
]


def site_list(daily: DataFrame, continuous: DataFrame) -> DataFrame:
    """Every site of either service with its least latitude and longitude, by site."""
    columns = ["site_no", "latitude", "longitude"]
    return (
        daily.select(*columns)
        .unionByName(continuous.select(*columns))
        .groupBy("site_no")
        .agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
        .orderBy("site_no")
    )


def list_sites(spark: SparkSession, root: str) -> DataFrame:
    """The site list of a lake. Of the files only the two coordinates are read."""
    places = ["latitude", "longitude"]
    return site_list(*(lake.read_service(spark, root, s, columns=places) for s in SERVICES))


def sites_geojson(sites: DataFrame) -> DataFrame:
    """Each site as a GeoJSON point feature: ``site_no, feature``. Works row by row."""
    geometry = F.struct(
        F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct("site_no").alias("properties"),
    )
    return sites.select("site_no", F.to_json(feature).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON: a feature per line, in as many files as it takes."""
    features.select("feature").write.mode("overwrite").text(path)


def metadata_rows(pages: DataFrame, param: str | None = None) -> DataFrame:
    """One row per listed series, with its ``page``; ``at`` and ``pos`` are its place."""
    rows = pages.select(
        "page",
        "at",
        F.col("features").isNull().alias("no_features"),
        F.posexplode_outer("features").alias("pos", "feature"),
    ).filter("no_features or pos is not null")
    p = "feature.properties"
    flat = rows.select(
        "page",
        "at",
        "pos",
        F.col(f"{p}.monitoring_location_id").alias("site_no"),
        F.coalesce(F.col(f"{p}.monitoring_location_name"), F.lit("")).alias("name"),
        *[F.col(f"{p}.{name}") for name in _SITE_FIELDS if name != "name"],
        *[F.col(f"{p}.{name}") for name in _SERIES_FIELDS],
    )
    flat = require(flat, F.col("site_no").isNotNull(), "metadata page or feature without a site")
    return flat if param is None else flat.filter(F.col("parameter_code") == param)


def _place() -> Column:
    return F.struct("at", "pos", "page")


def _is_listed() -> Column:
    """A row describes a series only if it names and codes the parameter."""
    return F.col("parameter_code").isNotNull() & F.col("parameter_name").isNotNull()


def site_headers(rows: DataFrame) -> DataFrame:
    """Site fields from the first row that names the site, its place, and ``n_series``."""
    return (
        rows.groupBy("site_no")
        .agg(
            F.min_by(F.struct(*_SITE_FIELDS), _place()).alias("site"),
            F.min(_place()).alias("first_place"),
            F.count_if(_is_listed()).alias("n_series"),
        )
        .select("site_no", "site.*", "first_place", "n_series")
    )


def site_series(rows: DataFrame) -> DataFrame:
    """Flat form: each series beside the fields of its site; a site without any keeps a row.

    Nothing is gathered per site. The rows are the side of the join that Spark can split
    when one site has very many.
    """
    placed = rows.select("site_no", *_SERIES_FIELDS, _place().alias("place"))
    stands_in = (F.col("n_series") == 0) & (F.col("place") == F.col("first_place"))
    series = {name: F.when(_is_listed(), F.col(name)) for name in [*_SERIES_FIELDS, "place"]}
    return (
        placed.join(site_headers(rows), "site_no")
        .filter(_is_listed() | stands_in)
        .withColumns(series)
        .drop("n_series")
    )


def site_metadata(rows: DataFrame) -> DataFrame:
    """Document form: a row per site with its ``series`` nested, in the order of the source.

    This is the shape of the metadata file, which holds one document per site. Reports use
    ``site_series``.
    """
    placed = F.when(_is_listed(), F.struct(_place().alias("place"), F.struct(*_SERIES_FIELDS).alias("s")))
    return (
        rows.groupBy("site_no")
        .agg(
            F.min_by(F.struct(*_SITE_FIELDS), _place()).alias("site"),
            F.array_sort(F.collect_list(placed)).alias("placed"),
            F.min(_place()).alias("first_place"),
        )
        .orderBy("first_place")
        .select("site_no", "site.*", F.col("placed.s").alias("series"))
    )


def flatten_metadata(metadata: DataFrame) -> DataFrame:
    """Document form to flat form, with ``place`` as the position within the site."""
    return metadata.select(
        "site_no", *_SITE_FIELDS, F.posexplode_outer("series").alias("place", "s")
    ).select("site_no", *_SITE_FIELDS, "place", "s.*")


def plain_number(value: Column) -> Column:
    """A double without exponent and without a needless ``.0``."""
    digits = F.regexp_replace(value.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    return F.coalesce(digits, value.cast("string"))


# The wording of the report.
REPORT_HEADING = "%s -- %s"
REPORT_AREA = "drainage area: %s sq mi"
REPORT_UNIT = "HUC %s"
REPORT_SERIES = "%s (%s)  stat %s  %s .. %s  [%s]"
REPORT_NO_SERIES = "(no matching parameter/statistic series)"
REPORT_STATUS = ("Primary", "Provisional")
NO_STATISTIC = "-"
UNKNOWN_DATE = "?"


def _text_unless_null(pattern: str, value: Column) -> Column:
    """A formatted value, or null so that ``concat_ws`` leaves it out."""
    return F.when(value.isNotNull(), F.format_string(pattern, value))


def site_report(series: DataFrame, unknown_date: str = UNKNOWN_DATE) -> DataFrame:
    """Flat series to report parts: ``site_no, heading, details, place, line``.

    Dates are cut to the day. A panel passes an empty ``unknown_date``.
    """

    def day(name: str) -> Column:
        return F.substring(F.coalesce(F.col(name), F.lit(unknown_date)), 1, 10)

    primary, provisional = REPORT_STATUS
    details = F.concat_ws(
        " | ",
        F.nullif(F.concat_ws(", ", "county_name", "state_name"), F.lit("")),
        _text_unless_null(REPORT_AREA, plain_number(F.col("drainage_area"))),
        _text_unless_null(REPORT_UNIT, F.col("hydrologic_unit_code")),
    )
    line = F.format_string(
        REPORT_SERIES,
        "parameter_name",
        "parameter_code",
        F.coalesce("statistic_id", F.lit(NO_STATISTIC)),
        day("begin"),
        day("end"),
        F.when(F.col("primary").isNotNull(), primary).otherwise(provisional),
    )
    has_series = F.col("parameter_code").isNotNull()
    return series.select(
        "site_no",
        F.format_string(REPORT_HEADING, "site_no", "name").alias("heading"),
        details.alias("details"),
        "place",
        F.when(has_series, line).otherwise(REPORT_NO_SERIES).alias("line"),
    )
