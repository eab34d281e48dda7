"""The driver's tables seen as readings, pages, sites, basins and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.operators.versions import sha256_of, with_previous


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_name(key: Column) -> Column:
    return F.concat(F.lit("USGS-"), F.lpad(key.cast("string"), 8, "0"))


def _param(flag: Column) -> Column:
    return F.when(flag == "A", "00060").when(flag == "N", "00065").otherwise("00010")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as daily readings: sites are suppliers, with many copies of a day."""
    line = F.col("l_linenumber")
    shipped = F.col("l_shipdate").cast("timestamp")
    modified = F.when(line < 7, shipped + F.make_dt_interval(days=line))
    return table(spark, sf_dir, "lineitem").select(
        site_name(F.col("l_suppkey")).alias("site_no"),
        _param(F.col("l_returnflag")).alias("param_cd"),
        F.to_date("l_shipdate").alias("datetime"),
        F.col("l_quantity").alias("value"),
        F.when(line == 1, "e").when(line == 2, "ICE,ESTIMATED").alias("qualifiers"),
        (F.lit(38.0) + F.col("l_suppkey") / 100.0).alias("latitude"),
        (F.lit(-85.0) + F.col("l_suppkey") / 50.0).alias("longitude"),
        F.when(F.col("l_linestatus") == "F", "Approved")
        .otherwise("Provisional")
        .alias("approval_status"),
        modified.alias("last_modified"),
        F.year("l_shipdate").cast("string").alias("year"),
    )


def _event_time() -> Column:
    """The event's hour with its fraction of a second, so that instants share seconds."""
    ts = F.col("ts").cast("timestamp")
    return F.date_trunc("hour", ts) + (ts - F.date_trunc("second", ts))


def continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as continuous readings of 40 sites."""
    site = F.col("user_id") % 40
    return (
        table(spark, sf_dir, "events")
        .select(
            site_name(site).alias("site_no"),
            F.when(F.col("event_type").isin("click", "view"), "00060")
            .otherwise("00065")
            .alias("param_cd"),
            _event_time().alias("datetime"),
            "value",
            F.when(F.col("event_type") == "error", "ICE").alias("qualifiers"),
            (F.lit(38.0) + site / 100.0).alias("latitude"),
            (F.lit(-85.0) + site / 50.0).alias("longitude"),
            F.when(F.col("event_id") % 3 == 0, "Approved")
            .otherwise("Provisional")
            .alias("approval_status"),
            F.col("ts").cast("timestamp").alias("last_modified"),
        )
        .withColumn("year", F.year("datetime").cast("string"))
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON pages of continuous readings: ``page, text``, one event to a page.

    By event type the qualifier is a string, a list, an empty list, null or absent; a
    purchase has no value and a signup one that is not a number.
    """
    kind = F.col("event_type")
    local = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value = F.when(kind == "purchase", "null").when(kind == "signup", '"Ice"').otherwise(
        F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))
    )
    qualifier = (
        F.when(kind == "error", ',"qualifier":"ICE"')
        .when(kind == "click", ',"qualifier":["A","B"]')
        .when(kind == "view", ',"qualifier":[]')
        .when(kind == "purchase", ',"qualifier":null')
        .otherwise("")
    )
    site = F.col("user_id") % 40
    text = F.format_string(
        '{"features":[{"properties":{"monitoring_location_id":"%s","parameter_code":"00060",'
        '"time":"%s-05:00","value":%s%s,"approval_status":"Provisional",'
        '"last_modified":"%sZ"},"geometry":{"coordinates":[%s,%s]}}],"links":[]}',
        site_name(site),
        local,
        value,
        qualifier,
        local,
        (F.lit(-85.0) + site / 50.0).cast("string"),
        (F.lit(38.0) + site / 100.0).cast("string"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("page"), text.alias("text")
    )


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as pages whose times are dates, instants or neither, by ship mode data."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    time = (
        F.when(flag == "A", day)
        .when(flag == "N", F.concat(day, F.lit("T00:00:00Z")))
        .otherwise(F.substring(day, 1, 7))
    )
    value = F.when((status == "O") & (F.col("l_linenumber") == 1), "null").otherwise('"1.5"')
    text = F.format_string(
        '{"features":[{"properties":{"monitoring_location_id":"%s","parameter_code":"00060",'
        '"time":"%s","value":%s},"geometry":{"coordinates":[]}}]}',
        site_name(F.col("l_suppkey")),
        time,
        value,
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("page"), text.alias("text")
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as landed pages, each linking to the next id; some addresses never landed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    following = pages.select(
        (F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url")
    )

    def as_link(rel: str, href: str) -> Column:
        return F.struct(F.lit(rel).alias("rel"), F.col(href).alias("href"))

    return (
        pages.filter(~F.contains("url", F.lit("#")))
        .join(following, "page_id", "left")
        .select(
            F.when(
                F.col("next_url").isNotNull(),
                F.array(as_link("self", "url"), as_link("next", "next_url")),
            )
            .otherwise(F.array(as_link("self", "url")))
            .alias("links")
        )
    )


def looping_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``linked_pages`` and some more that link around in circles; others lead into a few of those."""
    pages = table(spark, sf_dir, "pages").filter(F.col("page_id") % 40 < 6)

    def page(mark: str, following: str) -> Column:
        named = lambda rel, m: F.struct(
            F.lit(rel).alias("rel"), F.concat("url", F.lit(m)).alias("href")
        )
        return F.array(named("self", mark), named("next", following))

    circle = F.array(page("#1", "#2"), page("#2", "#3"), page("#3", "#1"))
    lead = F.array(page("#0", "#2"), page("#00", "#0"))
    both = F.when(F.col("page_id") % 40 < 3, circle).otherwise(F.concat(circle, lead))
    return linked_pages(spark, sf_dir).unionByName(pages.select(F.explode(both).alias("links")))


def metadata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and their series as JSON pages of site metadata, one series to a page."""
    series = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus")
        .agg(
            F.date_format(F.min("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("begin"),
            F.date_format(F.max("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("end"),
        )
    )
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    feature = F.struct(
        F.struct(
            site_name(F.col("s_suppkey")).alias("monitoring_location_id"),
            F.col("s_name").alias("monitoring_location_name"),
            F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("state_name"),
            F.when(F.col("s_nationkey") < 20, F.col("n_name")).alias("county_name"),
            F.lpad(F.col("s_nationkey").cast("string"), 8, "0").alias("hydrologic_unit_code"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("drainage_area"),
            _param(flag).alias("parameter_code"),
            F.when(~((flag == "R") & (status == "O")), F.concat(F.lit("Series "), flag)).alias(
                "parameter_name"
            ),
            F.when(status == "F", "00003").alias("statistic_id"),
            F.when(flag != "N", F.col("begin")).alias("begin"),
            F.col("end"),
            F.when(status == "F", "Primary").alias("primary"),
        ).alias("properties")
    )
    page = F.concat(site_name(F.col("s_suppkey")), F.lit("/"), flag, status)
    return (
        table(spark, sf_dir, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(series, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.coalesce(page, site_name(F.col("s_suppkey"))).alias("page"),
            F.to_json(F.struct(F.array(feature).alias("features"))).alias("text"),
        )
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rings of 32 positions: ``vec_id, ring``."""
    e = F.col("embedding")

    def position(i: Column) -> Column:
        lon = F.get(e, i * 2).cast("double") * 10.0 - 85.0
        lat = F.get(e, i * 2 + 1).cast("double") * 10.0 + 41.0
        return F.array(lon, lat)

    last = F.floor(F.size(e) / F.lit(2)).cast("int") - 1
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform(F.sequence(F.lit(0), last), position).alias("ring")
    )


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as basin documents: half of each ring outside, the rest as two holes.

    Vectors labelled 0 become a MultiPolygon of the first half and the second half.
    """
    ring = F.col("ring")
    outer, rest = F.slice(ring, 1, 16), F.slice(ring, 17, 16)
    holes = F.array(outer, F.slice(ring, 17, 8), F.slice(ring, 25, 8))
    one = F.struct(F.lit("Polygon").alias("type"), holes.alias("coordinates"))
    many = F.struct(
        F.lit("MultiPolygon").alias("type"),
        F.array(F.array(outer), F.array(rest)).alias("coordinates"),
    )

    def document(geometry: Column) -> Column:
        feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"))
        return F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
        )

    return rings(spark, sf_dir).select(
        site_name(F.col("vec_id")).alias("site_no"),
        F.when(F.col("label") == 0, document(many)).otherwise(document(one)).alias("document"),
    )


def published_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites with a published drainage area; for some it is not known."""
    area = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 1000.0)
    return table(spark, sf_dir, "supplier").select(
        site_name(F.col("s_suppkey")).alias("site_no"), area.alias("drainage_area")
    )


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document is one file; its source is the dataset and its language the version."""
    lang = F.col("lang")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"),
        F.when(lang == "de", 1).when(lang == "en", 2).when(lang == "es", 3).otherwise(4).cast(
            "bigint"
        ).alias("n"),
        F.col("doc_id").cast("string").alias("path"),
        sha256_of(F.col("text")).alias("sha256"),
        F.col("n_chars").alias("row_count"),
    )


def files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as found later: toxic documents were changed, poor ones are gone."""
    labels = table(spark, sf_dir, "labels")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .filter(F.coalesce(F.col("quality"), F.lit(1)) == 1)
        .select(
            F.col("source").alias("dataset"),
            F.col("doc_id").cast("string").alias("path"),
            sha256_of(text).alias("sha256"),
        )
    )


def documents_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of the documents as found later, as in ``files_on_disk``."""
    labels = table(spark, sf_dir, "labels")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .filter(F.coalesce(F.col("quality"), F.lit(1)) == 1)
        .select(F.col("doc_id").alias("path"), text.alias("text"))
    )


def pages_of_sites(pages: DataFrame) -> DataFrame:
    """Metadata pages put together, one with all features of each site."""
    feature = F.get_json_object("text", "$.features[0]")
    joined = F.array_join(F.array_sort(F.collect_list(feature)), ",")
    site = F.split("page", "/")[0]
    return pages.groupBy(site.alias("site")).agg(
        F.concat(F.lit('{"features":['), joined, F.lit("]}")).alias("text")
    ).select("text")


def order_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests: a customer's orders are one dataset's versions.

    Urgent orders name the wrong parent and open ones were never finished.
    """
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset"),
        key.alias("n"),
        sha256_of(F.concat_ws(":", key, F.date_format("o_orderdate", "yyyy-MM-dd"))).alias(
            "content_hash"
        ),
        "o_orderstatus",
        "o_orderpriority",
    )
    finished = F.col("o_orderstatus") != "P"
    chained = with_previous(orders.filter(finished), "dataset", "content_hash", "parent_hash")
    wrong = F.col("o_orderpriority") == "1-URGENT"
    number = F.concat(F.lit("v"), F.col("n").cast("string"), F.lit("-"))
    done = chained.select(
        "dataset",
        F.concat(number, F.substring("content_hash", 1, 8)).alias("dir_name"),
        "content_hash",
        F.when(wrong, F.col("content_hash")).otherwise(F.col("parent_hash")).alias("parent_hash"),
    )
    unfinished = orders.filter(~finished).select(
        "dataset",
        F.concat(number, F.lit("pending")).alias("dir_name"),
        "content_hash",
        F.lit(None).cast("string").alias("parent_hash"),
    )
    return done.unionByName(unfinished)
