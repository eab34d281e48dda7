"""Landed pages to a lake or to a single export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.functions.guards import require_rows
from riverlake.operators import sites
from riverlake.operators.cleaning import clean_readings
from riverlake.sources import lake, metadata
from riverlake.sources.pages import link, missing_pages, read_metadata_pages, read_reading_pages


def _landed(
    spark: SparkSession, landing: str, one_per_line: bool, complete: bool, url: Column | None
) -> DataFrame:
    pages = read_reading_pages(spark, landing, one_per_line)
    gap = missing_pages(pages, url).first() if complete else None
    if gap is not None:
        own = url if url is not None else link(F.col("links"), "self")
        unnamed = pages.filter(own.isNull()).select("page").first()
        if unnamed is not None:
            raise ValueError(
                f"{unnamed.page} has no self link, so whether all pages have landed cannot be"
                " told: pass their addresses as url, or turn complete off"
            )
        raise ValueError(f"page {gap.missing_url} has not landed; {gap.url} links to it")
    return pages


def _some(rows: int, landing: str) -> int:
    if not rows:
        raise ValueError(f"no readings in {landing}")
    return rows


def load_landed(
    spark: SparkSession,
    landing: str,
    root: str,
    service: str,
    one_per_line: bool = False,
    complete: bool = True,
    url: Column | None = None,
) -> int:
    """Append the readings of all landed pages to a lake; returns how many there were.

    All sites and windows go in one job. Bad pages, or none with a reading in them, are an
    error, and so is a chain of pages with a gap unless ``complete`` is off. A page's address
    is its ``self`` link, or else ``url`` over the columns of ``read_reading_pages``.
    """
    pages = _landed(spark, landing, one_per_line, complete, url)
    return _some(lake.append_readings(clean_readings(pages, service), root, service), landing)


def export_landed(
    spark: SparkSession,
    landing: str,
    path: str,
    service: str,
    one_per_line: bool = False,
    complete: bool = True,
    url: Column | None = None,
) -> int:
    """Write the readings of all landed pages to one folder, without partitions."""
    pages = _landed(spark, landing, one_per_line, complete, url)
    return _some(lake.write_export(clean_readings(pages, service), path, service), landing)


def load_metadata(
    spark: SparkSession,
    landing: str,
    path: str,
    param: str | None = None,
    one_per_line: bool = False,
) -> None:
    """Landed metadata pages to one JSON document per site. No series at all is an error."""
    rows = sites.metadata_rows(read_metadata_pages(spark, landing, one_per_line), param)
    metadata.write_metadata(
        sites.site_metadata(require_rows(rows, f"no metadata in {landing}")), path
    )
