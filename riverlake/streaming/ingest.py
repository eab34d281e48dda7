"""Landing folder to lake as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riverlake.operators.cleaning import clean_readings
from riverlake.schemas import READING_PAGE, STRICT_JSON, check_service
from riverlake.sources import fs, lake


def marker(checkpoint: str, batch: int) -> str:
    """The file that tells that a batch has been stored."""
    return f"{checkpoint.rstrip('/')}/stored/{batch}"


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    service: str,
    checkpoint: str,
    one_per_line: bool = False,
    max_files: int | None = None,
) -> StreamingQuery:
    """Append all pages that have landed since the last run, then stop.

    A batch leaves a marker beside the checkpoint once its readings are stored, and one that
    Spark repeats after a failure is passed over if its marker is there. Only a failure
    between the two can store readings twice, and every query keeps one copy of a reading.
    """
    check_service(service)
    reader = (
        spark.readStream.schema(READING_PAGE)
        .options(**STRICT_JSON)
        .option("multiLine", not one_per_line)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def append(pages: DataFrame, batch: int) -> None:
        if not fs.exists(spark, marker(checkpoint, batch)):
            lake.append_readings(clean_readings(pages, service), root, service)
            fs.create_new(spark, marker(checkpoint, batch))
            fs.delete(spark, marker(checkpoint, batch - 1))  # only the last can be repeated

    return (
        reader.json(landing)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
