"""Landed API pages: GeoJSON feature collections in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.schemas import METADATA_PAGE, READING_PAGE, STRICT_JSON
from riverlake.session import scratch_dir


def in_name_order(path: Column) -> Column:
    """A key that sorts paths by name, with the numbers in them by value."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    return F.array_join(padded, "")


def _read(spark: SparkSession, path: str, schema: str, one_per_line: bool) -> DataFrame:
    """Documents with ``page``, their file, and ``at``, a place that no two of them share.

    Places follow the names of files, then where in a file a task began to read, then the
    rising number that Spark gives the lines there.
    """
    at = F.struct(
        in_name_order(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return (
        spark.read.schema(schema)
        .options(**STRICT_JSON)
        .option("multiLine", not one_per_line)
        .json(path)
        .select(F.col("_metadata.file_path").alias("page"), at.alias("at"), "features", "links")
    )


def read_reading_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Pages of readings: one document per file, or one per line (which also splits)."""
    return _read(spark, path, READING_PAGE, one_per_line)


def read_metadata_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Pages of site metadata, in the same two forms."""
    return _read(spark, path, METADATA_PAGE, one_per_line)


def _parse(texts: DataFrame, page: Column, text: Column, schema: str) -> DataFrame:
    parsed = F.from_json(text, schema, STRICT_JSON)
    return texts.select(page.alias("page"), parsed.alias("doc")).select(
        "page", F.struct("page").alias("at"), "doc.features", "doc.links"
    )


def parse_reading_pages(texts: DataFrame, page: Column, text: Column) -> DataFrame:
    """Pages of readings held as JSON text in a column."""
    return _parse(texts, page, text, READING_PAGE)


def parse_metadata_pages(texts: DataFrame, page: Column, text: Column) -> DataFrame:
    return _parse(texts, page, text, METADATA_PAGE)


def link(links: Column, rel: str) -> Column:
    """Target of the first link of a kind, or null."""
    return F.get(F.filter(links, lambda x: x["rel"] == rel), F.lit(0))["href"]


def missing_pages(pages: DataFrame, url: Column | None = None) -> DataFrame:
    """Landed pages whose next page has not landed: ``url, missing_url``.

    A page's own address is its ``self`` link unless ``url`` gives it. An empty result
    means that every chain of pages was followed to its end.
    """
    own = url if url is not None else link(F.col("links"), "self")
    known = pages.select(own.alias("url"), link(F.col("links"), "next").alias("missing_url"))
    landed = known.select(F.col("url").alias("landed_url"))
    return known.filter("missing_url is not null").join(
        landed, F.col("missing_url") == F.col("landed_url"), "left_anti"
    )


def walk_chains(pages: DataFrame, url: Column | None = None) -> DataFrame:
    """Where following ``next`` from each landed page leads, for all pages at once.

    ``url, last_url, steps, missing_url, loops``: the last landed page that is reached, after how
    many steps, and the page that it links to but that has not landed. A page whose chain runs
    into a loop has no last page, and ``loops`` tells so.

    Every page points ahead, and in each round a page takes over the pointer of the page that
    it points to, which doubles the distance. Pages that have found their end leave the rounds, so
    the number of rounds is the logarithm of the longest chain. Distances have no gaps: a round
    that ends no page shows that those left are on their way around loops. An address that
    landed more than once counts once, with the least of its links.
    """
    own = url if url is not None else link(F.col("links"), "self")
    linked = pages.select(own.alias("url"), link(F.col("links"), "next").alias("next_url"))
    known = linked.where("url is not null").groupBy("url").agg(F.min("next_url").alias("next_url"))
    known = _kept(known, "pages")
    landed = known.select(F.col("url").alias("next_url"), F.lit(True).alias("has_landed"))
    pointed = known.join(_dealt(landed), "next_url", "left")
    goes_on = F.col("has_landed").isNotNull()
    ended = _kept(
        pointed.where(~goes_on).select(
            "url", F.col("url").alias("last_url"), F.lit(0).cast("long").alias("steps"),
            F.col("next_url").alias("missing_url"),
        ),
        "chain-ends",
    )
    waiting = _kept(
        pointed.where(goes_on).select("url", F.col("next_url").alias("at"), F.lit(1).cast("long").alias("steps")),
        "chain-pointers",
    )
    left, found, fresh = waiting.count(), ended, ended
    while left:
        ends = found.select(
            F.col("url").alias("at"), "last_url", F.col("steps").alias("more"), "missing_url"
        )
        fresh = _kept(
            waiting.join(_dealt(ends), "at").select(
                "url", "last_url", (F.col("steps") + F.col("more")).alias("steps"), "missing_url"
            ),
            "chain-ends",
        )
        ahead = waiting.select(F.col("url").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"))
        waiting = _kept(
            waiting.join(_dealt(fresh), "url", "left_anti").join(_dealt(ahead), "at").select(
                "url", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps")
            ),
            "chain-pointers",
        )
        before, left = left, waiting.count()
        if left == before:
            break
        found = found.unionByName(fresh)
    around = waiting.select(
        "url", F.lit(None).cast("string").alias("last_url"), F.lit(None).cast("long").alias("steps"),
        F.lit(None).cast("string").alias("missing_url"), F.lit(True).alias("loops"),
    )
    return found.withColumn("loops", F.lit(False)).unionByName(around)


def unreached_pages(pages: DataFrame, url: Column | None = None) -> DataFrame:
    """``url`` of pages that no chain reaches from a first page, one that nothing links to.

    They are the pages of loops that no other page leads into. A loop is known by the least
    address on it.
    """
    own = url if url is not None else link(F.col("links"), "self")
    linked = pages.select(own.alias("url"), link(F.col("links"), "next").alias("next_url"))
    known = linked.where("url is not null").groupBy("url").agg(F.min("next_url").alias("next_url"))
    looping = walk_chains(pages, url).where("loops").select("url")
    inside = _kept(known.join(_dealt(looping), "url"), "loop-pages")
    # The least address within 2^k steps ahead; around a loop all pages come to the same one.
    state = _kept(inside.select("url", F.col("next_url").alias("at"), F.col("url").alias("least")), "loops")
    reach, size = 1, state.count()
    while reach < size:
        ahead = state.select(F.col("url").alias("at"), F.col("at").alias("further"), F.col("least").alias("other"))
        state = _kept(
            state.join(_dealt(ahead), "at").select(
                "url", F.col("further").alias("at"), F.least("least", "other").alias("least")
            ),
            "loops",
        )
        reach *= 2
    # As many steps ahead every page is on its loop, and each page of a loop is where some page gets.
    around = state.select(F.col("at").alias("url")).distinct()
    loops = state.select(F.col("url").alias("at"), F.col("least").alias("loop"))
    loop_of = state.join(_dealt(loops), "at")
    entered = loop_of.join(_dealt(around), "url", "left_anti").select("loop").distinct()
    return loop_of.join(_dealt(around), "url", "left_semi").join(_dealt(entered), "loop", "left_anti").select("url")


def _dealt(df: DataFrame) -> DataFrame:
    """To be joined by dealing out both sides: a broadcast in each round adds up in the driver."""
    return df.hint("merge")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written once to the scratch folder, so that a round does not repeat those before it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
