"""Published dataset versions: file hashes, manifests, history and verification."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from riverlake.functions import wire
from riverlake.functions.guards import require
from riverlake.operators import readings as queries
from riverlake.operators.readings import ReadingFilter
from riverlake.schemas import MANIFEST, STRICT_JSON
from riverlake.session import scratch_dir
from riverlake.sources import fs, lake
from riverlake.sources.stores import Store, list_files, open_by_address, row_count, shared_out

GENERATOR = "riverlake/0.1.0"
MANIFEST_FILE = "manifest.json"
# Fixed value: how much of a hash names a version folder.
HASH_PREFIX = 8

_STREAM_BYTES = 8 * 1024 * 1024
ROWS_PER_FILE = 5_000_000
CLAIM_WAIT = 600.0  # seconds to wait for another publisher to give its version a name
# How many consecutive version numbers one task compares.
BLOCK_VERSIONS = 4096

_PENDING = "pending"
_VERSION_NAME = rf"\Av([0-9]+)-(?!{_PENDING}\z)"


# -- hashes ---------------------------------------------------------------------------


def sha256_of(content: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def file_facts(paths: DataFrame, folder: str, open_store: Store = open_by_address) -> DataFrame:
    """``paths`` with ``sha256`` and ``row_count`` of each ``path`` below a folder.

    Files of any size are read as a stream, a few megabytes at a time, wherever a task is;
    empty and hidden ones as well. A missing file has no hash, one that is not Parquet no
    row count. ``open_store`` turns a full path into a store and a name in it, for stores
    that need credentials or options.
    """
    base = fs.qualified(paths.sparkSession, folder)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for path in batch.column("path").to_pylist():
                store, name = open_store(f"{base}/{path}")
                digest = hashlib.sha256()
                try:
                    with store.open_input_stream(name, compression=None) as stream:
                        while chunk := stream.read(_STREAM_BYTES):
                            digest.update(chunk)
                except FileNotFoundError:
                    hashes.append(None)
                    counts.append(None)
                    continue
                hashes.append(digest.hexdigest())
                counts.append(row_count(store, name))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array(hashes, pa.string()), pa.array(counts, pa.int64())],
                ["path", "sha256", "row_count"],
            )

    names = paths.select("path").distinct().repartition(shared_out(paths.sparkSession), "path")
    return names.mapInArrow(step, "path string, sha256 string, row_count bigint")


def _paths(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(name,) for name in names], "path string")


def file_hashes(spark: SparkSession, folder: str, open_store: Store = open_by_address) -> DataFrame:
    """``path, sha256`` of every file below a folder, with paths relative to it.

    Files are listed and read by tasks; only the first level's names pass through the driver.
    """
    listed = list_files(spark, folder, open_store)
    return file_facts(listed, folder, open_store).select("path", "sha256")


def content_hashes(files: DataFrame, *by: str, totals: tuple[str, ...] = ()) -> DataFrame:
    """One row per version: ``*by, content_hash, n_files`` and the sum of each of ``totals``.

    The hash runs over the lines ``path:sha256`` in byte order of the paths, so it can only
    be taken in sequence. A version's lines are sorted by Spark, which spills, and then
    hashed and counted as they stream past; they are never held together.
    """
    keys, sums = list(by), list(totals)
    line = F.concat("path", F.lit(":"), "sha256", F.lit("\n"))
    ordered = (
        files.select(*by, "path", line.alias("line"), *totals)
        .repartition(*by)
        .sortWithinPartitions(*by, "path")
        .select(*by, "line", *totals)
    )
    columns = [*keys, "content_hash", "n_files", *sums]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, counts, kinds = None, None, None, None

        def plain(key: tuple) -> tuple:
            """Null equals null, and NaN equals NaN."""
            return tuple("NaN" if x != x else x for x in key)

        def done(rows: list[tuple]) -> pa.RecordBatch:
            types = [*kinds, pa.string(), *[pa.int64()] * (1 + len(sums))]
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            held = [batch.column(c).to_pylist() for c in [*keys, "line", *sums]]
            rows, ended = zip(*held), []
            for _, run in groupby(rows, key=lambda row: plain(row[: len(keys)])):
                run = list(run)
                key = run[0][: len(keys)]
                if digest is None or plain(key) != plain(current):
                    if digest is not None:
                        ended.append((*current, digest.hexdigest(), *counts))
                    current, digest, counts = key, hashlib.sha256(), [0] * (1 + len(sums))
                digest.update("".join(row[len(keys)] for row in run).encode("utf-8"))
                added = [sum(row[len(keys) + 1 + i] or 0 for row in run) for i in range(len(sums))]
                counts = [c + n for c, n in zip(counts, [len(run), *added])]
            if ended:
                yield done(ended)
        if digest is not None:
            yield done([(*current, digest.hexdigest(), *counts)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*by).schema)
    counted = ", ".join(f"`{name}` bigint" for name in ["n_files", *sums])
    return ordered.mapInArrow(fold, f"{kept}, content_hash string, {counted}")


# -- manifests ------------------------------------------------------------------------


def provenance(readings: DataFrame) -> DataFrame:
    """What a set of readings holds, in one row.

    ``row_count``, sorted distinct ``sites``, ``approval_status_counts`` and
    ``max_last_modified`` (as text, empty when unknown). The readings are reduced to one
    row per site and status, and those to one per site and one per status, before anything
    meets in one place.
    """
    per_pair = readings.groupBy("site_no", "approval_status").agg(
        F.count(F.lit(1)).alias("n"), F.max("last_modified").alias("modified")
    )
    parts = F.array(
        F.struct(F.lit("site").alias("kind"), F.col("site_no").alias("name")),
        F.struct(F.lit("status").alias("kind"), F.col("approval_status").alias("name")),
    )
    per_name = (
        per_pair.select(F.inline(parts), "n", "modified")
        .groupBy("kind", "name")
        .agg(F.sum("n").alias("n"), F.max("modified").alias("modified"))
    )
    status = F.when(F.col("kind") == "status", F.struct("name", "n"))
    return per_name.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "status", F.col("n"))), F.lit(0)).alias(
            "row_count"
        ),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "site", F.col("name")))).alias("sites"),
        F.map_from_entries(F.array_sort(F.collect_list(status))).alias("approval_status_counts"),
        wire.modified_text(F.max("modified")).alias("max_last_modified"),
    )


def manifest_totals(files: DataFrame, *by: str) -> DataFrame:
    """Content hash, file count and row count of each version, in one pass over its files."""
    return content_hashes(files, *by, totals=("row_count",))


def with_previous(versions: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Add ``value`` of the version before, within each dataset, in the order of ``n``.

    Numbers are compared in blocks, so that a dataset with very many versions is shared
    out among tasks; only the last value of each block is carried over to the next.
    """
    blocked = versions.withColumn("block", F.floor(F.col("n") / F.lit(BLOCK_VERSIONS)))
    ends = blocked.groupBy(by, "block").agg(F.max_by(value, "n").alias("carried"))
    carried = ends.withColumn(
        "carried", F.lag("carried").over(Window.partitionBy(by).orderBy("block"))
    )
    in_block = Window.partitionBy(by, "block").orderBy("n")
    return (
        blocked.withColumn("before", F.lag(value).over(in_block))
        .join(carried, [by, "block"])
        .withColumn(name, F.coalesce("before", "carried"))
        .drop("block", "before", "carried")
    )


def version_number(dir_name: Column) -> Column:
    """The n of ``v<n>-<hash>``, or null for any other name and for an unfinished version."""
    found = dir_name.rlike(_VERSION_NAME)
    return F.when(found, F.regexp_extract(dir_name, _VERSION_NAME, 1).try_cast("bigint"))


def version_history(manifests: DataFrame, by: str = "dataset") -> DataFrame:
    """Numbered versions of each dataset, with ``chain_ok``: does each name its parent?

    Needs ``dir_name, content_hash, parent_hash``; folders that are no version fall out.
    """
    numbered = manifests.withColumn("n", version_number(F.col("dir_name"))).filter("n is not null")
    return (
        with_previous(numbered, by, "content_hash", "previous_hash")
        .withColumn("chain_ok", F.equal_null("parent_hash", "previous_hash"))
        .drop("previous_hash")
    )


def _version_names(spark: SparkSession, dataset: str) -> list[tuple[int, str]]:
    """Finished versions below a dataset folder, oldest first."""
    names = [(re.match(_VERSION_NAME.replace(r"\z", r"\Z"), n), n) for n in fs.subfolders(spark, dataset)]
    return sorted((int(m.group(1)), n) for m, n in names if m)


def read_manifests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Manifests of the given version folders, with ``dir_name``. A missing one is an error."""
    if not folders:
        return spark.createDataFrame([], MANIFEST).withColumn("dir_name", F.lit(""))
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{MANIFEST_FILE}$", 1)
    manifests = (
        spark.read.schema(MANIFEST)
        .options(**STRICT_JSON)
        .option("multiLine", True)
        .json([f"{folder}/{MANIFEST_FILE}" for folder in folders])
        .select("*", name.alias("dir_name"))
    )
    required = [f for f in manifests.columns if f != "parent_hash"]
    complete = reduce(and_, (F.col(f).isNotNull() for f in required))
    return require(manifests, complete, F.concat(F.lit("incomplete manifest in "), "dir_name"))


def versions(spark: SparkSession, publish_root: str, name: str) -> DataFrame:
    """All published versions of a dataset, oldest first, as a summary with ``chain_ok``."""
    dataset = f"{publish_root.rstrip('/')}/{name.strip()}"
    folders = [f"{dataset}/{n}" for _, n in _version_names(spark, dataset)]
    manifests = read_manifests(spark, folders).withColumn("dataset", F.lit(name.strip()))
    return (
        version_history(manifests)
        .select(
            "dataset",
            "n",
            "dir_name",
            "content_hash",
            "parent_hash",
            "created_at",
            "row_count",
            "source.sites",
            "source.param_cd",
            "source.start",
            "source.end",
            "upstream_state.max_last_modified",
            "upstream_state.approval_status_counts",
            "chain_ok",
        )
        .orderBy("n")
    )


# -- publish --------------------------------------------------------------------------


def _write_files(readings: DataFrame, folder: str, rows: int, rows_per_file: int) -> None:
    """Write data files whose bytes and names depend on the readings alone.

    Sites and years are dealt out over a number of files that follows from the row count.
    A site has one reading per exported second, so a site's year has a bounded size and no
    file can grow beyond that. Within a file readings are sorted and no two share a place.
    """
    count = max(1, -(-rows // rows_per_file))
    slot = F.pmod(F.xxhash64("site_no", F.year("datetime")), F.lit(count)).cast("int")
    (
        readings.repartitionById(count, slot)
        .sortWithinPartitions("site_no", "datetime", "param_cd")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
        .parquet(folder)
    )
    spark = readings.sparkSession
    for name in fs.file_names(spark, folder):
        part = re.match(r"part-(\d+)-", name)
        if part:
            fixed = f"data-{int(part.group(1)):05d}.parquet"
            fs.rename(spark, f"{folder}/{name}", f"{folder}/{fixed}")
        else:
            fs.delete(spark, f"{folder}/{name}")


def manifest_head(
    files: DataFrame,
    held: Row,
    wanted: ReadingFilter,
    parent_hash: str | None,
    generator: str = GENERATOR,
    created_at: str | None = None,
) -> dict:
    """The manifest of a version without its list of files.

    ``files`` has ``path, sha256, row_count``, and ``held`` is a row of ``provenance``.
    """
    totals = manifest_totals(files.withColumn("n", F.lit(1)), "n").first()
    now = dt.datetime.now(dt.timezone.utc).isoformat().replace("+00:00", "Z")
    return {
        "content_hash": totals.content_hash if totals else hashlib.sha256().hexdigest(),
        "parent_hash": parent_hash,
        "created_at": created_at or now,
        "generator": generator,
        "source": {
            "collection": wanted.service,
            "sites": held.sites,
            "param_cd": wanted.param_cd,
            "start": wanted.start or "",
            "end": wanted.end or "",
        },
        "upstream_state": {
            "max_last_modified": held.max_last_modified,
            "approval_status_counts": held.approval_status_counts,
        },
        "row_count": totals.row_count if totals else 0,
    }


def write_manifest(
    files: DataFrame, folder: str, head: dict, open_store: Store = open_by_address
) -> None:
    """Write a manifest: ``head`` and, in order of paths, all ``files``, one to a line.

    The sorted rows are streamed into the store by a task, so their number has no bound. A
    task writes under a name of its own, and the one that succeeded gives the manifest.
    """
    spark = files.sparkSession
    base, opening = fs.qualified(spark, folder), json.dumps(head, indent=2)[: -len("\n}")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{MANIFEST_FILE}.{TaskContext.get().taskAttemptId()}"
        store, path = open_store(f"{base}/{name}")
        with store.open_output_stream(path) as out:
            out.write((opening + ',\n  "files": [').encode("utf-8"))
            between = "\n    "
            for batch in batches:
                for row in batch.to_pylist():
                    out.write((between + json.dumps(row)).encode("utf-8"))
                    between = ",\n    "
            out.write(b"\n  ]\n}\n")
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    ordered = files.select("path", "sha256", "row_count").repartition(1).sortWithinPartitions("path")
    written = ordered.mapInArrow(step, "name string").first()
    if written is None:  # no files at all, so no task
        fs.write_text(spark, f"{folder}/{MANIFEST_FILE}", json.dumps({**head, "files": []}, indent=2))
        return
    fs.rename(spark, f"{folder}/{written.name}", f"{folder}/{MANIFEST_FILE}")
    for name in fs.file_names(spark, folder):
        if name.startswith(f"{MANIFEST_FILE}."):  # of a task that was lost
            fs.delete(spark, f"{folder}/{name}")


def _claimed(spark: SparkSession, dataset: str, wait: float) -> tuple[int, str, str | None]:
    """The next version number, the file that claims it, and the newest version's hash.

    The claim is a file that only one publisher can create. Others wait until that version
    has its name and take the next number, so numbers and parents follow each other.
    """
    until = time.monotonic() + wait
    while True:
        known = _version_names(spark, dataset)
        n = known[-1][0] + 1 if known else 1
        claim = f"{dataset}/.v{n}.claim"
        if fs.create_new(spark, claim):
            if _version_names(spark, dataset) == known:
                parent = read_manifests(spark, [f"{dataset}/{known[-1][1]}"]).first() if known else None
                return n, claim, parent.content_hash if parent else None
            fs.delete(spark, claim)  # finished by another between the look and the claim
        elif time.monotonic() > until:
            raise TimeoutError(f"another publisher holds {claim}; delete it if there is none")
        else:
            time.sleep(0.2)


def publish(
    spark: SparkSession,
    lake_root: str,
    publish_root: str,
    wanted: ReadingFilter,
    name: str,
    generator: str = GENERATOR,
    rows_per_file: int = ROWS_PER_FILE,
    claim_wait: float = CLAIM_WAIT,
) -> DataFrame:
    """Publish what a filter selects as the next version of a dataset; returns its summary.

    The version is built in a folder that readers skip, and gets its number and name only when
    the data is complete. Publishers at the same time get numbers one after the other. The
    same readings give the same hash.
    """
    name = name.strip()
    if not name:
        raise ValueError("a dataset needs a name")
    dataset = f"{publish_root.rstrip('/')}/{name}"
    # Keeping the latest copies is the costly step: do it once, and go on from the result.
    staged_at = scratch_dir(spark, "publish")
    pending, claim = f"{dataset}/{_PENDING}-{uuid.uuid4().hex}", None
    try:
        selected = queries.filtered_readings(spark, lake_root, wanted)
        exported = queries.as_exported(selected, wanted.service)
        exported.write.mode("overwrite").option("compression", "zstd").parquet(staged_at)
        staged = lake.read_export(spark, staged_at, wanted.service)
        held = provenance(staged).first()
        if not held.row_count:
            raise ValueError("no reading passes the filter, so there is no version to publish")
        _write_files(staged, pending, held.row_count, rows_per_file)
        facts = stored_facts(file_facts(list_files(spark, pending), pending))
        n, claim, parent_hash = _claimed(spark, dataset, claim_wait)
        head = manifest_head(facts, held, wanted, parent_hash, generator)
        write_manifest(facts, pending, head)
        fs.rename(spark, pending, f"{dataset}/v{n}-{head['content_hash'][:HASH_PREFIX]}")
    finally:
        fs.delete(spark, staged_at)
        fs.delete(spark, pending)  # gone already if all went well
        if claim:
            fs.delete(spark, claim)
    return versions(spark, publish_root, name).filter(F.col("n") == n)


def stored_facts(facts: DataFrame) -> DataFrame:
    """Facts about files, read once and kept as a small table; several columns need them."""
    path = scratch_dir(facts.sparkSession, "facts")
    facts.write.mode("overwrite").parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


# -- verify ---------------------------------------------------------------------------


def compare_files(declared: DataFrame, actual: DataFrame, *by: str) -> DataFrame:
    """Each declared file with ``actual_sha256`` (empty if missing) and whether it is ``same``."""
    found = actual.select(*by, "path", F.col("sha256").alias("actual_sha256"))
    return declared.join(found, [*by, "path"], "left").withColumns(
        {
            "actual_sha256": F.coalesce("actual_sha256", F.lit("")),
            "same": F.equal_null("sha256", "actual_sha256"),
        }
    )


def verify_totals(compared: DataFrame, *by: str) -> DataFrame:
    """Per version: ``ok``, file counts, and the content hash that the files give now."""
    now = compared.select(
        *by,
        "path",
        F.col("actual_sha256").alias("sha256"),
        (~F.col("same")).cast("int").alias("n_mismatched"),
    )
    return (
        content_hashes(now, *by, totals=("n_mismatched",))
        .withColumnRenamed("content_hash", "actual_hash")
        .withColumn("ok", F.col("n_mismatched") == 0)
    )


def check_version(
    spark: SparkSession, folder: str, open_store: Store = open_by_address
) -> tuple[DataFrame, DataFrame]:
    """Rehash a version's declared files and compare with its manifest, in two tables.

    The first has one row. Its ``ok`` looks at the files alone, a missing one counting as
    changed, and ``n_mismatched`` counts those. Beside it stand whether the content hash that the
    manifest states agrees with it, and whether the files' footers hold as many rows as it
    states for each file and in all. The second has a row for each mismatched file: ``dir_name,
    path, sha256, actual_sha256``. Files that the manifest does not declare are not read.
    """
    manifest = read_manifests(spark, [folder])
    declared = manifest.select("dir_name", F.inline("files"))
    actual = file_facts(declared, folder, open_store).withColumnRenamed("row_count", "n_rows")
    actual = stored_facts(actual).withColumn("dir_name", F.lit(folder.rsplit("/", 1)[-1]))
    compared = compare_files(declared, actual, "dir_name")
    counted = (
        declared.join(actual.select("path", "n_rows"), "path", "left")
        .groupBy("dir_name")
        .agg(
            F.bool_and(F.coalesce(F.col("n_rows") == F.col("row_count"), F.lit(False))).alias("each"),
            F.sum("n_rows").alias("all"),
        )
    )
    stated = (
        manifest.join(counted, "dir_name", "left")
        .select(
            "dir_name",
            F.col("content_hash").alias("expected_hash"),
            (
                F.coalesce("each", F.lit(True))
                & (F.coalesce("all", F.lit(0)) == F.col("row_count"))
            ).alias("row_count_ok"),
        )
    )
    no_files = sha256_of(F.lit(""))
    summary = stated.join(verify_totals(compared, "dir_name"), "dir_name", "left").select(
        "dir_name",
        F.coalesce("ok", F.lit(True)).alias("ok"),
        "expected_hash",
        F.coalesce("actual_hash", no_files).alias("actual_hash"),
        F.coalesce("n_mismatched", F.lit(0)).alias("n_mismatched"),
        (F.col("expected_hash") == F.coalesce("actual_hash", no_files)).alias("content_hash_ok"),
        "row_count_ok",
    )
    changed = compared.where(~F.col("same")).select("dir_name", "path", "sha256", "actual_sha256")
    return summary, changed


def verify_version(
    spark: SparkSession, folder: str, open_store: Store = open_by_address
) -> DataFrame:
    """The summary of ``check_version``, in one row."""
    return check_version(spark, folder, open_store)[0]


def mismatched_files(
    spark: SparkSession, folder: str, open_store: Store = open_by_address
) -> DataFrame:
    """The files of a version that are missing or not as its manifest says, a row for each."""
    return check_version(spark, folder, open_store)[1]


def verify_published(
    spark: SparkSession, publish_root: str, name: str, dir_name: str, open_store: Store = open_by_address
) -> DataFrame:
    return verify_version(spark, f"{publish_root.rstrip('/')}/{name.strip()}/{dir_name}", open_store)
