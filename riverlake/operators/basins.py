"""Drainage basins: areas from GeoJSON, checked against published areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riverlake.functions import sphere
from riverlake.functions.guards import require
from riverlake.functions.wire import fixed_decimals
from riverlake.schemas import BASIN_DOCUMENT
from riverlake.sources.basins import write_basins

# Square miles to square kilometres, and how far a ratio may be from 1.
SQ_MI_TO_KM2 = 2.589_988
AREA_TOLERANCE = 0.10

_POLYGON = "array<array<array<double>>>"
_MULTIPOLYGON = "array<array<array<array<double>>>>"


def _polygons(feature: Column) -> Column:
    """A feature's geometry as a list of polygons; null for any other type."""
    kind, text = feature["geometry"]["type"], feature["geometry"]["coordinates"]
    return F.when(kind == "Polygon", F.array(F.from_json(text, _POLYGON))).when(
        kind == "MultiPolygon", F.from_json(text, _MULTIPOLYGON)
    )


def basin_areas(basins: DataFrame) -> DataFrame:
    """``site_no, nldi_area_km2`` of each basin document, whole in its row: no shuffle.

    A document that is not a collection of polygons fails the job.
    """
    parsed = basins.select("site_no", F.from_json("document", BASIN_DOCUMENT).alias("doc")).select(
        "site_no", F.transform("doc.features", _polygons).alias("shapes")
    )
    valid = F.coalesce(F.forall("shapes", sphere.positions_ok), F.lit(False))
    message = F.concat(F.lit("not a basin of polygons: "), F.col("site_no"))
    square_metres = F.aggregate(
        "shapes", F.lit(0.0), lambda total, s: total + sphere.multipolygon_area_m2(s)
    )
    return require(parsed, valid, message).select(
        "site_no", (square_metres / F.lit(1e6)).alias("nldi_area_km2")
    )


def _ratio(area: Column, published: Column) -> Column:
    """A floating-point quotient: dividing by zero is infinite, not an error."""
    by_zero = (
        F.when(area > 0, float("inf")).when(area < 0, float("-inf")).otherwise(float("nan"))
    )
    return F.when(published == 0, by_zero).otherwise(F.try_divide(area, published))


def basin_check(areas: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Compare basin areas with the published ones; ``metadata`` holds square miles.

    A basin without a published area stays, with ratio and mismatch unknown. Without
    metadata at all that is every basin.
    """
    if metadata is None:
        compared = areas.withColumn("drainage_area", F.lit(None).cast("double"))
    else:
        compared = areas.join(metadata.select("site_no", "drainage_area"), "site_no", "left")
    ratio = F.col("area_ratio")
    off = ~F.isnan(ratio) & (F.abs(ratio - 1.0) > AREA_TOLERANCE)
    return (
        compared.withColumn("nwis_drainage_area_km2", F.col("drainage_area") * SQ_MI_TO_KM2)
        .withColumn("area_ratio", _ratio(F.col("nldi_area_km2"), F.col("nwis_drainage_area_km2")))
        .select(
            "site_no",
            "nldi_area_km2",
            "nwis_drainage_area_km2",
            "area_ratio",
            F.when(ratio.isNotNull(), off).alias("mismatch"),
        )
    )


def missing_basins(requested: DataFrame, basins: DataFrame) -> DataFrame:
    """Requested sites for which no basin has landed."""
    return requested.select("site_no").join(basins.select("site_no"), "site_no", "left_anti")


def summary_rows(checked: DataFrame) -> DataFrame:
    """The check as text with fixed decimals, empty where unknown."""
    places = {"nldi_area_km2": 3, "nwis_drainage_area_km2": 3, "area_ratio": 4}
    texts = [
        F.coalesce(fixed_decimals(F.col(name), n), F.lit("")).alias(name)
        for name, n in places.items()
    ]
    return checked.select("site_no", *texts)


def write_summary(checked: DataFrame, path: str) -> None:
    """The check as CSV with a header."""
    summary_rows(checked).write.mode("overwrite").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def run_basins(
    requested: DataFrame, basins: DataFrame, metadata: DataFrame | None, path: str
) -> None:
    """Write basins and summary for the sites that have one, then fail if some have none.

    All sites without a basin are listed in ``missing_basins.csv`` beside the summary.
    """
    wanted = basins.join(requested.select("site_no"), "site_no", "left_semi")
    write_basins(wanted, f"{path}/basins")
    write_summary(basin_check(basin_areas(wanted), metadata), f"{path}/basins.csv")
    listed, missing = f"{path}/missing_basins.csv", Observation()
    (
        missing_basins(requested, basins)
        .distinct()
        .observe(missing, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .option("header", True)
        .csv(listed)
    )
    count = missing.get["n"]
    if count:
        raise ValueError(f"basins of {count} requested sites have not landed; {listed} lists them")


def read_missing_basins(spark: SparkSession, path: str) -> DataFrame:
    """The list that ``run_basins`` left."""
    return spark.read.option("header", True).csv(f"{path}/missing_basins.csv", schema="site_no string")
