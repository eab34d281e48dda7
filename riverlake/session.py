"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

# Readings are UTC, and stored timestamps need min/max statistics (INT96 has none).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every job in this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, if that is still possible."""
    with suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name for intermediate tables, visible to every executor.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local
    session, whose executors share one disk, may fall back to a temporary folder. What is
    in it goes when the application ends, or by ``remove_dir`` once nothing reads it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/riverlake-{label}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix=f"riverlake-{label}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    atexit.register(remove_dir, spark, path)
    return path
