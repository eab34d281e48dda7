"""Small helpers shared by the operators here: row passes in Arrow batches, and names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riverlake.session import remove_dir, scratch_dir

BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffle files when they end, as nothing runs them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str, free_shuffles: bool = False, **options: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: a lost executor costs a reread, never the work before. On request the
    shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    path = scratch_dir(df.sparkSession, f"llm-{label}")
    with _shuffles_freed(df.sparkSession) if free_shuffles else nullcontext():
        df.write.mode("overwrite").options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more; of others, none."""
    if path := getattr(table, "scratch_path", None):
        remove_dir(table.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Let Spark send rows to Python in batches of a few megabytes, however long texts are.

    A batch has at least one row. Its bytes are held in the JVM and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def over_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """A pass of ``step`` over (id, text) in small Arrow batches; a null text is empty."""
    narrow = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(start, BATCH_ROWS)

    return narrow.mapInArrow(lambda batches: step(small(batches)), StructType.fromDDL(schema))
