"""Landed reading pages to typed readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlake.functions import parsing
from riverlake.functions.guards import keep_or_fail
from riverlake.schemas import DAILY, check_service


def page_readings(pages: DataFrame) -> DataFrame:
    """One row per feature, every field still as it came, plus parsed forms beside it.

    A page without ``features`` yields one row with a null ``feature``, for the check to see.
    """
    features = pages.select(
        F.col("features").isNull().alias("no_features"),
        F.explode_outer("features").alias("feature"),
    ).filter("no_features or feature is not null")
    p = F.col("feature.properties")
    value_text = F.try_variant_get(p["value"], "$", "string")
    coordinates = F.col("feature.geometry.coordinates")
    return features.select(
        "no_features",
        p.alias("p"),
        coordinates.alias("coordinates"),
        parsing.number(value_text).alias("number"),
        parsing.local_date(p["time"]).alias("date"),
        parsing.instant(p["time"]).alias("instant"),
        parsing.instant(p["last_modified"]).alias("modified"),
    )


def _is_malformed() -> Column:
    """Whether a page would not parse: a required field is missing or has another type."""
    p = F.col("p")
    value_kind = F.schema_of_variant(p["value"])
    return (
        F.col("no_features")
        | p["monitoring_location_id"].isNull()
        | p["parameter_code"].isNull()
        | p["time"].isNull()
        | F.col("coordinates").isNull()
        | F.exists("coordinates", F.isnull)
        | (p["value"].isNotNull() & ~value_kind.isin("STRING", "VOID"))
        | ~parsing.is_text_or_texts(p["qualifier"])
    )


def _rules(service: str) -> list[tuple[Column, str | None, Column]]:
    """What decides about a reading, in order; a rule without a message drops the row."""
    p = F.col("p")
    wrong_kind = F.col("instant" if check_service(service) == DAILY else "date").isNotNull()
    return [
        (_is_malformed(), "malformed page", p["monitoring_location_id"]),
        (F.col("number").isNull(), None, p["time"]),
        (F.col("date").isNull() & F.col("instant").isNull(), "cannot read time", p["time"]),
        (
            p["last_modified"].isNotNull() & F.col("modified").isNull(),
            "cannot read last_modified",
            p["last_modified"],
        ),
        (wrong_kind, f"time does not suit the {service} service", p["time"]),
    ]


def clean_readings(pages: DataFrame, service: str) -> DataFrame:
    """Typed readings of one service, from pages with ``features``.

    Readings without a numeric value are dropped. Anything else that is wrong fails the
    job, whichever columns it goes on to use; see ``keep_or_fail``. One narrow pass.
    """
    datetime = "date" if check_service(service) == DAILY else "instant"
    p = F.col("p")
    lon, lat = F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))
    return (
        page_readings(pages)
        .filter(keep_or_fail(_rules(service)))
        .select(
            p["monitoring_location_id"].alias("site_no"),
            p["parameter_code"].alias("param_cd"),
            F.col(datetime).alias("datetime"),
            F.col("number").alias("value"),
            F.nullif(parsing.joined_text(p["qualifier"]), F.lit("")).alias("qualifiers"),
            F.coalesce(lat, F.lit(0.0)).alias("latitude"),
            F.coalesce(lon, F.lit(0.0)).alias("longitude"),
            F.coalesce(p["approval_status"], F.lit("")).alias("approval_status"),
            F.col("modified").alias("last_modified"),
        )
    )


def page_report(pages: DataFrame, service: str) -> DataFrame:
    """How many features meet which rule: ``outcome, n``, for a look before the append."""
    chain = None
    for condition, message, _ in _rules(service):
        outcome = F.lit(message or "dropped: no numeric value")
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return (
        page_readings(pages)
        .groupBy(chain.otherwise("kept").alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
