"""Site metadata documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverlake.schemas import SITE_METADATA, STRICT_JSON
from riverlake.sources import fs


def write_metadata(metadata: DataFrame, path: str) -> None:
    """JSON documents, one line per site; absent fields are written as null."""
    metadata.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_metadata(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Read JSON lines, or with ``one_array`` a single array. A missing path reads as empty."""
    if not fs.exists(spark, path):
        return spark.createDataFrame([], SITE_METADATA)
    return (
        spark.read.schema(SITE_METADATA)
        .options(**STRICT_JSON)
        .option("multiLine", one_array)
        .json(path)
    )
