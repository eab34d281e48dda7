"""Small file-system steps through Hadoop, so that they work on any shared store.

Only names and manifests pass through here, never data.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    fs, target = _resolve(spark, path)
    if not fs.exists(target):
        return []
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path``."""
    fs, target = _resolve(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isFile()]


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of ``path``, as file listings spell it."""
    fs, target = _resolve(spark, path)
    return fs.makeQualified(target).toString()


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, from_path = _resolve(spark, source)
    to_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not fs.rename(from_path, to_path):
        raise OSError(f"could not rename {source} to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _resolve(spark, path)
    if not fs.mkdirs(target):
        raise OSError(f"could not create {path}")


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _resolve(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _resolve(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, unless there is one; tells whether this call created it."""
    fs, target = _resolve(spark, path)
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if fs.exists(target):
            return False
        raise error
    return True
