"""The partitioned reading lake, and single exports.

Layout: ``<root>/service=S/site_no=X/param_cd=P/year=Y/part-*.parquet``. The two services
are separate tables because their ``datetime`` columns differ in type.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riverlake.schemas import (
    PARTITION_COLUMNS,
    SERVICES,
    check_service,
    lake_schema,
    reading_schema,
    stored_schema,
)
from riverlake.sources import fs
from riverlake.sources.small_files import (
    ParquetFile,
    is_local,
    read_partitioned,
    write_partitioned,
)
from riverlake.sources.stores import Store, latest_day, open_by_address, shared_out, walk

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_PARTITION_FOLDER = re.compile(r"site_no=(.*)")
# Spark lists, and opens the files of, a lake that seems to have no more series and years than this.
FOLDERS_BY_SPARK = 10_000
# By how many sites, spread over the lake, that is judged.
SITES_JUDGED = 16


def service_root(root: str, service: str) -> str:
    return f"{root.rstrip('/')}/service={check_service(service)}"


def reading_year(datetime: Column) -> Column:
    """The year of a date, or the UTC year of an instant, as the path spells it."""
    return F.year(datetime).cast("string")


def append_readings(readings: DataFrame, root: str, service: str) -> int:
    """Append readings to the lake and return how many were written.

    Nothing is merged: a reading that is fetched again is stored again, and queries keep
    the latest copy. Rows are dealt out by ranges of site, parameter, year and time: a series
    is one file a run, and one that is too big for a task spans several, cut by time. So the
    number of files is that of series and tasks together, whatever the sizes. Files are
    sorted by time to keep their ``datetime`` statistics tight. A run that fails or has no
    rows adds nothing. On a local disk, where a file that Hadoop creates costs a process,
    tasks write and move the files through Arrow.
    """
    spark = readings.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*PARTITION_COLUMNS, "datetime"]
    placed = (
        readings.select(*reading_schema(service).fieldNames())
        .withColumn("year", reading_year(F.col("datetime")))
        .repartitionByRange(tasks, *order, "last_modified")
    )
    target = service_root(root, service)
    if is_local(fs.qualified(spark, target)):
        schema = _stored_as(spark, service)
        return write_partitioned(
            placed.sortWithinPartitions(*order),
            target,
            PARTITION_COLUMNS,
            ".zstd.parquet",
            lambda out: ParquetFile(out, schema),
        )
    written = Observation()
    (
        placed.observe(written, F.count(F.lit(1)).alias("rows"))
        .sortWithinPartitions(*order)
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(target)
    )
    return written.get["rows"]


def _stored_as(spark: SparkSession, service: str) -> pa.Schema:
    """A lake file's columns for Arrow. With the version named, Spark takes old dates as they are."""
    kinds = {"date": pa.date32(), "double": pa.float64(), "string": pa.string()}
    kinds["timestamp"] = pa.timestamp("us", tz="UTC")
    columns = [(f.name, kinds[f.dataType.simpleString()]) for f in stored_schema(service)]
    return pa.schema(columns, metadata={"org.apache.spark.version": spark.version})


def _empty(spark: SparkSession, service: str) -> DataFrame:
    return spark.createDataFrame([], lake_schema(service))


def _site_folders(
    spark: SparkSession, root: str, service: str, sites: list[str] | None
) -> list[str]:
    """Names of the folders of some sites, or of all: one listing.

    It is made through Arrow on a local disk, as through Hadoop each name is a few calls to the JVM.
    """
    base = service_root(root, service)
    if not fs.exists(spark, base):
        return []
    address = fs.qualified(spark, base)
    if is_local(address):
        listed = _partition_folders(*open_by_address(address), "site_no")
        named = [(site, path.rsplit("/", 1)[-1]) for site, path in listed]
    else:
        found = ((name, _PARTITION_FOLDER.fullmatch(name)) for name in fs.subfolders(spark, base))
        named = [(unquote(site[1]), name) for name, site in found if site]
    wanted = set(sites or ())
    return [name for site, name in named if not wanted or site in wanted]


def _for_spark(spark: SparkSession, base: str, sites: list[str]) -> bool:
    """Whether the folders of sites are so few that Spark may hold all their names in the driver.

    This only tells how rows are read, not which.
    """
    address = fs.qualified(spark, base)
    if not sites or not is_local(address):
        return True
    store, top = open_by_address(address)
    some = sites[:: -(-len(sites) // SITES_JUDGED)]
    found = sum(
        len(_partition_folders(store, series, "year"))
        for site in some
        for _, series in _partition_folders(store, f"{top}/{site}", "param_cd")
    )
    return found * len(sites) <= FOLDERS_BY_SPARK * len(some)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Reads in here list folders in as many tasks as a shuffle has, not in one for each site."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), shared_out(spark))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_service(
    spark: SparkSession,
    root: str,
    service: str,
    sites: list[str] | None = None,
    columns: list[str] | None = None,
    param_cd: str | None = None,
    years: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """One service's table. A lake without that service reads as an empty table.

    With ``sites`` only their folders are listed below the first level; the caller still
    filters, so this never changes a result, it only saves listing a lake of millions of
    folders. So do ``param_cd`` and ``years``, the first and last. ``columns`` names the stored
    columns to take, by default all; those of the path are always there. On a local disk tasks
    list and read the files of a lake with very many folders, whose names the driver cannot hold.
    """
    base, schema = service_root(root, service), lake_schema(service)
    stored = [f.name for f in stored_schema(service) if columns is None or f.name in columns]
    found = _site_folders(spark, root, service, sites)
    if not found and (sites or not fs.exists(spark, base)):
        return _empty(spark, service).select(*stored, *PARTITION_COLUMNS)
    if _for_spark(spark, base, found):
        folders = [f"{base}/{name}" for name in found] if sites else [base]
        reader = spark.read.schema(schema).option("basePath", base)
        with _few_listing_tasks(spark):
            table = reader.parquet(*folders)
        return table if columns is None else table.select(*stored, *PARTITION_COLUMNS)

    def takes(column: str, value: str | None) -> bool:
        if column == "param_cd":
            return param_cd is None or value == param_cd
        if value is None or not re.fullmatch("[0-9]+", value):
            return True
        first, last = years
        return (first is None or int(value) >= first) and (last is None or int(value) <= last)

    arrow = _stored_as(spark, service)
    kinds = pa.schema([arrow.field(name) for name in stored])
    result = ", ".join(
        f"{name} {schema[name].dataType.simpleString()}" for name in [*stored, *PARTITION_COLUMNS]
    )
    return read_partitioned(spark, base, found, PARTITION_COLUMNS, kinds, result, takes)


def register_lake(spark: SparkSession, root: str, columns: list[str] | None = None) -> None:
    """Temporary views ``daily`` and ``continuous`` over a lake, with the stored ``columns`` or all."""
    for service in SERVICES:
        read_service(spark, root, service, columns=columns).createOrReplaceTempView(service)


def _newest(
    store: FileSystem, folder: str, param_cd: str | None
) -> Iterator[tuple[str, dt.date]]:
    """Parameter and latest date of each series below a site's folder, from footers alone.

    Per parameter the newest year's files are opened, or those of the year before if they
    hold no rows, and so on.
    """
    for param, param_folder in _partition_folders(store, folder, "param_cd"):
        if param_cd is not None and param != param_cd:
            continue
        years = [(int(year), path) for year, path in _partition_folders(store, param_folder, "year")]
        for _, path in sorted(years, reverse=True):
            # As Spark's own listing does, leave out what is hidden or not yet committed.
            files = [
                name
                for name in walk(store, path)
                if name.endswith(".parquet") and not re.search(r"/[_.]", name[len(path) :])
            ]
            days = (latest_day(store, name, "datetime") for name in files)
            latest = max((day for day in days if day is not None), default=None)
            if latest is not None:
                yield param, latest
                break


def _partition_folders(store: FileSystem, folder: str, column: str) -> list[tuple[str, str]]:
    """Values and paths of the partition folders of a column directly below a folder."""
    prefix = f"{column}="
    return [
        (unquote(info.base_name.removeprefix(prefix)), info.path)
        for info in store.get_file_info(FileSelector(folder))
        if info.type == FileType.Directory and info.base_name.startswith(prefix)
    ]


def latest_dates(
    spark: SparkSession,
    root: str,
    service: str,
    param_cd: str | None = None,
    sites: list[str] | None = None,
    open_store: Store = open_by_address,
) -> DataFrame:
    """Date of the latest reading of each series: ``site_no, param_cd, max_date``.

    The driver lists the sites' folders, through Arrow, as through Hadoop each name would be a few
    calls to the JVM. A task takes some of them, lists the parameters and
    years below, and reads the footers of the files of each series' newest year: no other
    year's folder is listed, no data page is read, and nothing is shuffled but names of sites.
    A file without statistics of ``datetime`` is an error.
    """
    schema = "site_no string, param_cd string, max_date date"
    base = service_root(root, service)
    if not fs.exists(spark, base):
        return spark.createDataFrame([], schema)
    wanted = None if not sites else set(sites)
    address = fs.qualified(spark, base)
    named = _partition_folders(*open_store(address), "site_no")
    folders = [
        (site, path.rsplit("/", 1)[-1]) for site, path in named if wanted is None or site in wanted
    ]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(address)
        for batch in batches:
            rows = [
                (site, param, day)
                for site, folder in zip(*[c.to_pylist() for c in batch.columns])
                for param, day in _newest(store, f"{place}/{folder}", param_cd)
            ]
            if rows:
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["site_no", "param_cd", "max_date"])

    kinds = [pa.string(), pa.string(), pa.date32()]
    listed = spark.createDataFrame(folders, "site_no string, folder string")
    return listed.repartition(shared_out(spark), "folder").mapInArrow(step, schema)


def write_export(readings: DataFrame, path: str, service: str) -> int:
    """All nine columns as Parquet in one folder, without partitions; returns the row count.

    A small export ends up in one file and a large one in as many as it needs.
    """
    written = Observation()
    (
        readings.select(*reading_schema(service).fieldNames())
        .hint("rebalance")
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )
    return written.get["rows"]


def read_export(spark: SparkSession, path: str, service: str) -> DataFrame:
    """Also reads a published version, whose folder holds a manifest beside the data."""
    reader = spark.read.schema(reading_schema(service)).option("pathGlobFilter", "*.parquet")
    return reader.parquet(path)
