"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.checks import adapters
from riverlake.functions import parsing, sphere
from riverlake.operators import basins, cleaning, readings, sites, versions
from riverlake.operators.readings import ReadingFilter
from riverlake.plans import requests
from riverlake.plans.loading import load_landed
from riverlake.schemas import CONTINUOUS, DAILY, PARTITION_COLUMNS
from riverlake.session import configure, scratch_dir
from riverlake.sources import fs, lake, metadata, pages
from riverlake.sources.small_files import write_texts
from riverlake.sources.stores import list_files
from riverlake.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]

DAILY_FILTER = ReadingFilter(start="1996-01-01", end="2000-12-31")
CONTINUOUS_FILTER = ReadingFilter(service=CONTINUOUS, start="2024-01-03", end="2024-01-25")

_lakes: dict[tuple[str, str], str] = {}


def lake_of(spark: SparkSession, sf_dir: str) -> str:
    """A lake holding both adapters' readings, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes or not fs.exists(spark, _lakes[key]):
        root = scratch_dir(spark, "lake")
        lake.append_readings(adapters.daily(spark, sf_dir), root, DAILY)
        lake.append_readings(adapters.continuous(spark, sf_dir), root, CONTINUOUS)
        _lakes[key] = root
    return _lakes[key]


def _text_times(df: DataFrame, service: str) -> DataFrame:
    """Times as text, so that any engine can compare them."""
    with_year = df if "year" in df.columns else df.withColumn("year", F.lit(None).cast("string"))
    wire = readings.to_wire(with_year, service)
    return wire if "year" in df.columns else wire.drop("year", "service")


# -- readings -------------------------------------------------------------------------


def daily_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = readings.latest_matching(adapters.daily(spark, sf_dir), DAILY_FILTER)
    return readings.to_wire(readings.in_order(latest, DAILY), DAILY)


def continuous_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = readings.latest_matching(adapters.continuous(spark, sf_dir), CONTINUOUS_FILTER)
    return readings.to_wire(readings.in_order(latest, CONTINUOUS), CONTINUOUS)


def lake_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first query again, from the written lake."""
    return readings.query_readings(spark, lake_of(spark, sf_dir), DAILY_FILTER)


def daily_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(readings.keep_latest(adapters.daily(spark, sf_dir), DAILY), DAILY)


def continuous_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = adapters.continuous(spark, sf_dir)
    return _text_times(readings.keep_latest(table, CONTINUOUS), CONTINUOUS)


def sites_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings at the sites of a table: suppliers in credit."""
    supplier = adapters.table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    wanted = supplier.select(adapters.site_name(F.col("s_suppkey")).alias("site_no"))
    table = readings.at_sites(adapters.daily(spark, sf_dir), wanted)
    return _text_times(readings.latest_matching(table, ReadingFilter()), DAILY)


def single_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ReadingFilter().only("USGS-00000007")
    latest = readings.filtered_readings(spark, lake_of(spark, sf_dir), wanted)
    return readings.to_wire(latest, DAILY)


def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = adapters.continuous(spark, sf_dir)
    return readings.to_wire(readings.keep_latest(table, CONTINUOUS), CONTINUOUS)


def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = readings.from_wire(wire_rows(spark, sf_dir), CONTINUOUS)
    return back.withColumns(
        {
            "datetime": F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "last_modified": F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        }
    )


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_list(adapters.daily(spark, sf_dir), adapters.continuous(spark, sf_dir))


def lake_site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.list_sites(spark, lake_of(spark, sf_dir))


def distinct_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.distinct_values(adapters.daily(spark, sf_dir), "site_no")


def sites_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.sites_geojson(site_list(spark, sf_dir))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = readings.latest_matching(adapters.daily(spark, sf_dir), ReadingFilter())
    return readings.to_wire(latest, DAILY)


def readings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.page(_shown(spark, sf_dir), 3)


def readings_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.page(_shown(spark, sf_dir), 150)


def readings_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.page_after(_shown(spark, sf_dir), "USGS-00000007", "1998-06-15", "00060")


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.page_count(_shown(spark, sf_dir))


def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = readings.chart_series(_shown(spark, sf_dir))
    return points.withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss"))


# -- landed pages ---------------------------------------------------------------------


def parse_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = pages.parse_reading_pages(
        adapters.landed_pages(spark, sf_dir), F.col("page"), F.col("text")
    )
    return _text_times(cleaning.clean_readings(landed, CONTINUOUS), CONTINUOUS)


def kind_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = pages.parse_reading_pages(
        adapters.mixed_pages(spark, sf_dir), F.col("page"), F.col("text")
    )
    return cleaning.page_report(landed, DAILY)


def normalize_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_suppkey").cast("string")
    typed = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("  "), number, F.lit(" ")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("XX-"), number))
        .otherwise(number)
    )
    listed = F.concat(typed, F.lit(", "), F.col("l_partkey").cast("string"), F.lit(",Y-1"))
    return adapters.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        parsing.site_id(typed).alias("site_no"),
        F.array_join(parsing.site_ids(listed), ",").alias("site_nos"),
    )


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.missing_pages(adapters.linked_pages(spark, sf_dir))


def page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each landed page leads, and which pages no first page leads to."""
    landed = adapters.looping_pages(spark, sf_dir)
    unreached = pages.unreached_pages(landed).withColumn("unreached", F.lit(True))
    return pages.walk_chains(landed).join(unreached.hint("merge"), "url", "left").fillna(False, ["unreached"])


def _landing(spark: SparkSession, sf_dir: str) -> str:
    landing = scratch_dir(spark, "landing")
    adapters.landed_pages(spark, sf_dir).select("text").write.text(landing)
    return landing


def landed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files into a lake in one job, and all that is stored there."""
    root = scratch_dir(spark, "loaded")
    load_landed(spark, _landing(spark, sf_dir), root, CONTINUOUS, one_per_line=True)
    return _text_times(lake.read_service(spark, root, CONTINUOUS), CONTINUOUS)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files through the stream into a lake, and read from there."""
    root = scratch_dir(spark, "streamed")
    stream = start_ingest(
        spark,
        _landing(spark, sf_dir),
        root,
        CONTINUOUS,
        checkpoint=scratch_dir(spark, "stream-checkpoint"),
        one_per_line=True,
    )
    stream.awaitTermination()
    table = lake.read_service(spark, root, CONTINUOUS)
    return _text_times(readings.keep_latest(table, CONTINUOUS), CONTINUOUS)


# -- requests -------------------------------------------------------------------------


def _text_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumns(
        {
            "window_start": F.col("window_start").cast("string"),
            "window_end": F.col("window_end").cast("string"),
        }
    )


def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of each supplier's shipments, asked for from both services."""
    spans = adapters.daily(spark, sf_dir).groupBy("site_no").agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end")
    )
    both = [
        requests.with_windows(spans, s).withColumn("service", F.lit(s)) for s in (DAILY, CONTINUOUS)
    ]
    return _text_windows(both[0].unionByName(both[1]))


def lake_max_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = lake_of(spark, sf_dir)
    both = [
        lake.latest_dates(spark, root, s).withColumn("service", F.lit(s))
        for s in (DAILY, CONTINUOUS)
    ]
    return both[0].unionByName(both[1]).withColumn("max_date", F.col("max_date").cast("string"))


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as sites; only some have data in the lake."""
    wanted = adapters.table(spark, sf_dir, "customer").select(
        adapters.site_name(F.col("c_custkey")).alias("site_no")
    )
    plans = [
        requests.resume_requests(
            spark, wanted, CONTINUOUS, param, lake_of(spark, sf_dir), "2019-01-01", "2024-06-30"
        ).withColumn("param_cd", F.lit(param))
        for param in ("00060", "00065")
    ]
    return _text_windows(plans[0].unionByName(plans[1]))


# -- lake -----------------------------------------------------------------------------


def lake_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake.register_lake(spark, lake_of(spark, sf_dir), ["qualifiers"])
    counts = [
        spark.table(service)
        .groupBy(*PARTITION_COLUMNS)
        .agg(F.count(F.lit(1)).alias("n"), F.count("qualifiers").alias("n_qualified"))
        .withColumn("service", F.lit(service))
        for service in (DAILY, CONTINUOUS)
    ]
    return counts[0].unionByName(counts[1])


def single_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "export")
    lake.write_export(adapters.daily(spark, sf_dir), path, DAILY)
    return _text_times(lake.read_export(spark, path, DAILY), DAILY)


# -- sites ----------------------------------------------------------------------------


def _metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = pages.parse_metadata_pages(
        adapters.metadata_pages(spark, sf_dir), F.col("page"), F.col("text")
    )
    return sites.metadata_rows(landed)


def site_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        sites.site_series(_metadata_rows(spark, sf_dir))
        .withColumns({"first_page": F.col("first_place.page"), "page": F.col("place.page")})
        .drop("first_place", "place")
    )


def metadata_pages_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from files, with all series of a site on a page and many pages in a file."""
    landing = scratch_dir(spark, "metadata-pages")
    adapters.pages_of_sites(adapters.metadata_pages(spark, sf_dir)).write.text(landing)
    rows = sites.metadata_rows(pages.read_metadata_pages(spark, landing, one_per_line=True))
    return sites.site_series(rows).drop("first_place", "place")


def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "metadata")
    metadata.write_metadata(sites.site_metadata(_metadata_rows(spark, sf_dir)), path)
    return sites.flatten_metadata(metadata.read_metadata(spark, path))


def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sites.site_report(sites.site_series(_metadata_rows(spark, sf_dir)))
    return report.withColumn("page", F.col("place.page")).drop("place")


# -- basins ---------------------------------------------------------------------------


def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    km2 = F.abs(sphere.ring_area_m2(F.col("ring"))) / 1e6
    return adapters.rings(spark, sf_dir).select("vec_id", F.round(km2, 3).alias("area_km2"))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basin_areas(adapters.basins(spark, sf_dir))


def basin_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).withColumn("nldi_area_km2", F.round("nldi_area_km2", 3))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basin_check(_areas(spark, sf_dir), adapters.published_areas(spark, sf_dir))


def basin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).withColumns(
        {
            "nldi_area_km2": F.round("nldi_area_km2", 3),
            "nwis_drainage_area_km2": F.round("nwis_drainage_area_km2", 3),
            "area_ratio": F.round("area_ratio", 6),
        }
    )


def basin_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "basins-csv")
    basins.write_summary(_checked(spark, sf_dir), path)
    columns = ["site_no", "nldi_area_km2", "nwis_drainage_area_km2", "area_ratio"]
    table = spark.read.option("header", True).csv(path, schema=", ".join(f"{c} string" for c in columns))
    return table.fillna("")


def basins_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = adapters.table(spark, sf_dir, "orders").select(
        adapters.site_name(F.col("o_orderkey")).alias("site_no")
    )
    return basins.missing_basins(requested, adapters.basins(spark, sf_dir))


def basins_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that the basin job leaves of the sites for which it fails."""
    requested = adapters.table(spark, sf_dir, "orders").select(
        adapters.site_name(F.col("o_orderkey")).alias("site_no")
    )
    path = scratch_dir(spark, "basins-job")
    with suppress(ValueError):
        basins.run_basins(requested, adapters.basins(spark, sf_dir), None, path)
    return basins.read_missing_basins(spark, path)


# -- versions -------------------------------------------------------------------------


def _document_files(spark: SparkSession, documents: DataFrame) -> str:
    """A folder with a file for each row of ``path, text``."""
    folder = scratch_dir(spark, "document-files")
    part = F.pmod(F.xxhash64("path"), F.lit(64))
    doc = F.col("path").cast("string").alias("doc")
    write_texts(documents.select(part.cast("string").alias("part"), doc, "text"), folder, ["part", "doc"])
    return folder


def _document(path: Column) -> Column:
    return F.regexp_extract(path, "(?:^|/)doc=([^/]*)/", 1)


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to a file of its own, and the hashes of those files."""
    documents = adapters.table(spark, sf_dir, "documents")
    folder = _document_files(spark, documents.select(F.col("doc_id").alias("path"), "text"))
    hashes = versions.file_hashes(spark, folder)
    return hashes.select(_document(F.col("path")).alias("path"), "sha256").filter("path <> ''")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.documents_as_files(spark, sf_dir)
    return versions.content_hashes(files, "dataset")


def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language of a source is the next version of its dataset."""
    totals = versions.manifest_totals(adapters.documents_as_files(spark, sf_dir), "dataset", "n")
    return versions.with_previous(totals, "dataset", "content_hash", "parent_hash")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = readings.latest_matching(adapters.daily(spark, sf_dir), ReadingFilter())
    counts = F.transform(
        F.map_entries("approval_status_counts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return versions.provenance(latest).select(
        "row_count",
        F.array_join("sites", ",").alias("sites"),
        F.array_join(counts, ",").alias("approval_status_counts"),
        "max_last_modified",
    )


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_history(adapters.order_manifests(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = adapters.documents_as_files(spark, sf_dir).drop("n")
    return versions.compare_files(declared, adapters.files_on_disk(spark, sf_dir), "dataset")


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.verify_totals(_compared(spark, sf_dir), "dataset")


def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mismatched = _compared(spark, sf_dir).filter("not same")
    return mismatched.select("dataset", "path", "sha256", "actual_sha256")


def verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version on disk whose toxic documents were changed and poor ones removed.

    It also declares a hidden and empty file, which is as it was.
    """
    left = adapters.documents_left(spark, sf_dir)
    folder = _document_files(spark, left)
    fs.write_text(spark, f"{folder}/.empty", "")
    found = list_files(spark, folder).withColumnRenamed("path", "file")
    declared = (
        adapters.table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").cast("string").alias("doc"),
            versions.sha256_of(F.concat("text", F.lit("\n"))).alias("sha256"),
        )
        .join(found.withColumn("doc", _document(F.col("file"))), "doc", "left")
        .select(
            F.coalesce("file", F.concat(F.lit("doc="), "doc", F.lit("/gone"))).alias("path"),
            "sha256",
            F.lit(1).cast("bigint").alias("row_count"),
        )
    )
    empty = spark.createDataFrame([(".empty", "", 0)], declared.schema)
    empty = empty.withColumn("sha256", versions.sha256_of(F.lit("")))
    files = versions.stored_facts(declared.unionByName(empty))
    held = versions.provenance(adapters.daily(spark, sf_dir)).first()
    versions.write_manifest(files, folder, versions.manifest_head(files, held, ReadingFilter(), None))
    report, mismatched = versions.check_version(spark, folder)
    return mismatched.join(report, "dir_name").select(
        "ok", "content_hash_ok", _document(F.col("path")).alias("path")
    )


def publish_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions, the last two with the same readings, and what verifying them says."""
    root, target = lake_of(spark, sf_dir), scratch_dir(spark, "published")
    for wanted in (DAILY_FILTER, ReadingFilter(), ReadingFilter()):
        versions.publish(spark, root, target, wanted, "flow")
    history = versions.versions(spark, target, "flow")
    names = [r.dir_name for r in history.select("dir_name").collect()]
    first, *rest = [
        versions.verify_published(spark, target, "flow", d) for d in names
    ]
    for report in rest:
        first = first.unionByName(report)
    return history.join(first, "dir_name").select(
        "n",
        "row_count",
        F.size("sites").alias("n_sites"),
        "param_cd",
        "start",
        "end",
        "max_last_modified",
        F.col("approval_status_counts")["Approved"].alias("n_approved"),
        F.coalesce(F.col("content_hash") == F.col("parent_hash"), F.lit(False)).alias("repeated"),
        "chain_ok",
        "ok",
        "content_hash_ok",
        "row_count_ok",
    )


_QUERIES: list[Query] = [
    daily_filtered,
    continuous_filtered,
    lake_filtered,
    daily_latest,
    continuous_latest,
    sites_semi,
    single_site,
    wire_rows,
    wire_roundtrip,
    site_list,
    lake_site_list,
    distinct_sites,
    sites_geojson,
    readings_page,
    readings_deep_page,
    readings_page_after,
    page_count,
    chart_series,
    parse_readings,
    kind_mismatch,
    normalize_sites,
    missing_pages,
    page_chains,
    landed_load,
    stream_ingest,
    request_windows,
    lake_max_date,
    incremental_plan,
    lake_layout,
    single_roundtrip,
    site_metadata,
    metadata_pages_landed,
    metadata_roundtrip,
    site_report,
    ring_area,
    basin_area,
    basin_check,
    basin_csv,
    basins_missing,
    basins_missing_report,
    file_hashes,
    content_hash,
    manifest_build,
    provenance,
    version_history,
    verify_report,
    verify_files,
    verify_tampered,
    publish_roundtrip,
]


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {query.__name__: _configured(query) for query in _QUERIES}
