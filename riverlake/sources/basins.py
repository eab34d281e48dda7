"""Landed basin documents, one GeoJSON file or folder per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.functions.parsing import unescaped
from riverlake.sources import fs
from riverlake.sources.small_files import write_texts


def read_basins(spark: SparkSession, path: str) -> DataFrame:
    """Basin files ``<site>.geojson``, or ``site_no=<site>`` folders: ``site_no, document``."""
    # The file address is escaped, and a partition folder's name is so once more.
    address = unescaped(F.col("_metadata.file_path"))
    folder = F.nullif(F.regexp_extract("file", r"/site_no=([^/]+)/", 1), F.lit(""))
    name = F.regexp_extract("file", r"([^/]+)\.geojson$", 1)
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(address.alias("file"), F.col("value").alias("document"))
        .select(F.coalesce(unescaped(folder), name).alias("site_no"), "document")
    )


def write_basins(basins: DataFrame, path: str) -> None:
    """Each document into the folder of its site."""
    fs.delete(basins.sparkSession, path)
    write_texts(basins.select("site_no", F.col("document").alias("value")), path, ["site_no"])
