"""Queries over readings: filter, keep the latest copy, export, page, chart."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from riverlake.functions import parsing, wire
from riverlake.functions.guards import require
from riverlake.schemas import DAILY, DEFAULT_PARAM, check_service, reading_schema
from riverlake.sources import lake

PAGE_ROWS = 100
# How many rows ahead of a page a top-k may carry along.
SHALLOW_ROWS = 10_000


@dataclass(frozen=True)
class ReadingFilter:
    """Which readings to take. No sites means all; an empty date means no bound."""

    sites: tuple[str, ...] = ()
    service: str = DAILY
    param_cd: str = DEFAULT_PARAM
    start: str | None = None
    end: str | None = None

    def only(self, site_no: str) -> ReadingFilter:
        """The same filter for one site, as picked on a map."""
        return replace(self, sites=(site_no,))


def filter_date(text: str | None, label: str) -> dt.date | None:
    return parsing.strict_date(text, label) if text else None


def at_sites(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """Readings of the sites in a table. Spark broadcasts it only if it is small enough."""
    return readings.join(sites.select("site_no"), "site_no", "left_semi")


def matching(readings: DataFrame, wanted: ReadingFilter) -> DataFrame:
    """Apply a filter. Site, parameter and year prune folders; dates reach the file scan.

    The year bounds follow from the dates and say nothing new, but Spark cannot derive
    them, and without them every year's folder would be opened.
    """
    start = filter_date(wanted.start, "start")
    end = filter_date(wanted.end, "end")
    rows = readings.filter(F.col("param_cd") == wanted.param_cd)
    if wanted.sites:
        rows = rows.filter(F.col("site_no").isin(list(wanted.sites)))
    kind = reading_schema(wanted.service)["datetime"].dataType
    year = F.col("year").cast("int")
    if start:
        rows = rows.filter((F.col("datetime") >= F.lit(start).cast(kind)) & (year >= start.year))
    if end:
        # The end day counts as a whole.
        after = F.date_add(F.lit(end), 1).cast(kind)
        rows = rows.filter((F.col("datetime") < after) & (year <= end.year))
    return rows


def keep_latest(readings: DataFrame, service: str) -> DataFrame:
    """One row per site, parameter and exported time: the one modified last.

    Two instants within one second count as the same time. Rows that tie are ordered by
    all other columns, so the choice does not depend on the order of the files. Spark
    turns rank 1 into a limit per key ahead of the shuffle, so of a key with very many
    copies each task sends on one row.
    """
    key = wire.shown_datetime(F.col("datetime"), service)
    order = [
        F.col("last_modified").desc_nulls_last(),
        F.col("value").desc(),
        F.col("approval_status").asc(),
        F.col("qualifiers").asc_nulls_last(),
        F.col("datetime").asc(),
        F.col("latitude").asc(),
        F.col("longitude").asc(),
    ]
    # Time leads the sort: it tells rows apart sooner than site names with a common prefix.
    window = Window.partitionBy(key, "site_no", "param_cd").orderBy(*order)
    return (
        readings.withColumn("copy", F.row_number().over(window)).filter("copy = 1").drop("copy")
    )


def latest_matching(readings: DataFrame, wanted: ReadingFilter) -> DataFrame:
    """Filter first, then keep the latest copy: a date bound does not pass the window."""
    return keep_latest(matching(readings, wanted), wanted.service)


def in_order(readings: DataFrame, service: str) -> DataFrame:
    """By site, then time as exported."""
    return readings.orderBy("site_no", wire.shown_datetime(F.col("datetime"), service))


def filtered_readings(spark: SparkSession, root: str, wanted: ReadingFilter) -> DataFrame:
    """The latest copies of the readings a filter asks for, from a lake. Not sorted."""
    start, end = filter_date(wanted.start, "start"), filter_date(wanted.end, "end")
    table = lake.read_service(
        spark,
        root,
        wanted.service,
        list(wanted.sites),
        param_cd=wanted.param_cd,
        years=(start and start.year, end and end.year),
    )
    return latest_matching(table, wanted)


def query_readings(spark: SparkSession, root: str, wanted: ReadingFilter) -> DataFrame:
    """A filter's readings from a lake, in order and in export form."""
    rows = in_order(filtered_readings(spark, root, wanted), wanted.service)
    return to_wire(rows, wanted.service)


def to_wire(readings: DataFrame, service: str) -> DataFrame:
    """Export form: the service is named and times are text."""
    return readings.select(
        "site_no",
        "param_cd",
        F.lit(check_service(service)).alias("service"),
        "year",
        wire.datetime_text(F.col("datetime"), service).alias("datetime"),
        "value",
        "qualifiers",
        "latitude",
        "longitude",
        "approval_status",
        wire.modified_text(F.col("last_modified")).alias("last_modified"),
    )


def from_wire(rows: DataFrame, service: str) -> DataFrame:
    """Export form back to readings, at the precision it was exported with."""
    is_daily = check_service(service) == DAILY
    text = F.col("datetime")
    parsed = parsing.local_date(text) if is_daily else parsing.instant(text)
    modified = F.nullif(F.col("last_modified"), F.lit(""))
    times_ok = parsed.isNotNull() & (modified.isNull() | parsing.instant(modified).isNotNull())
    checked = require(rows, times_ok, F.concat(F.lit("cannot read time in row: "), text))
    return checked.select(
        "site_no",
        "param_cd",
        parsed.alias("datetime"),
        "value",
        F.nullif(F.col("qualifiers"), F.lit("")).alias("qualifiers"),
        "latitude",
        "longitude",
        "approval_status",
        parsing.instant(modified).alias("last_modified"),
    )


def as_exported(readings: DataFrame, service: str) -> DataFrame:
    """What ``from_wire(to_wire(...))`` gives, without the trip through text."""
    return readings.select(*reading_schema(service).fieldNames()).withColumn(
        "datetime", wire.shown_datetime(F.col("datetime"), service)
    )


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """The distinct values of a text column, without null."""
    return table.select(column).filter(F.col(column).isNotNull()).distinct()


_SHOWN = ["site_no", "param_cd", "datetime", "value", "approval_status"]


def page(rows: DataFrame, number: int) -> DataFrame:
    """Page ``number`` (from 0) of exported rows, by site, time and parameter.

    A page near the start is a top-k. For a deeper one rows are counted per site, then per day
    of the sites that the page touches, and only the days that hold the page are sorted. So
    page 1,000,000 costs a count of all rows and a sort of a few days.
    """
    start = PAGE_ROWS * number
    shown = rows.select(*_SHOWN)
    if start > SHALLOW_ROWS:
        day = F.substring("datetime", 1, 10)
        for key in (F.col("site_no"), F.struct("site_no", day.alias("day"))):
            held, before = _keys_holding(shown, key, start)
            shown = shown.filter(key.between(*held) if held else F.lit(False))
            start -= before
    return shown.orderBy("site_no", "datetime", "param_cd").offset(start).limit(PAGE_ROWS)


def _keys_holding(rows: DataFrame, key: Column, start: int) -> tuple[list[Column], int]:
    """First and last value of ``key`` that a page from row ``start`` touches, and the rows before.

    There is a short row per value. What comes back are the values of one page at most.
    """
    counts = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    touched = placed.filter(
        (F.col("before") < start + PAGE_ROWS) & (F.col("before") + F.col("n") > start)
    )
    ends = touched.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("before").alias("before")).first()
    if ends.before is None:
        return [], start

    def value(x: Row | str) -> Column:
        if isinstance(x, str):
            return F.lit(x)
        return F.struct(*[F.lit(v).alias(k) for k, v in x.asDict().items()])

    return [value(ends.low), value(ends.high)], ends.before


def page_after(rows: DataFrame, site_no: str, datetime: str, param_cd: str) -> DataFrame:
    """The page that follows a given last row; costs the same however deep it lies."""
    site = F.col("site_no")
    time = F.col("datetime")
    later = (site > site_no) | (
        (site == site_no)
        & ((time > datetime) | ((time == datetime) & (F.col("param_cd") > param_cd)))
    )
    return page(rows.filter((site >= site_no) & later), 0)


def page_count(rows: DataFrame) -> DataFrame:
    """``n_rows, n_pages``; no rows still make one page."""
    n = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(n / F.lit(PAGE_ROWS))).cast("bigint")
    return rows.agg(n.alias("n_rows"), pages.alias("n_pages"))


def chart_series(rows: DataFrame) -> DataFrame:
    """Points ``site_no, x, value`` of each site's line, from exported rows, in long form.

    A date is drawn at midnight UTC. Rows with a time that cannot be read are left out.
    """
    text = F.col("datetime")
    x = F.coalesce(parsing.instant(text), parsing.local_date(text).cast("timestamp"))
    return (
        rows.select("site_no", x.alias("x"), "value")
        .filter("x is not null")
        .orderBy("site_no", "x")
    )
