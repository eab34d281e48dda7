"""Small tables of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlake.schemas import datetime_type


def readings(spark, rows, service="daily"):
    """Rows of site, parameter, time, value, and optionally when last modified."""
    full = [(r + (None,))[:5] for r in rows]
    df = spark.createDataFrame(
        full, "site_no string, param_cd string, t string, value double, m string"
    )
    return df.select(
        "site_no",
        "param_cd",
        F.col("t").cast(datetime_type(service)).alias("datetime"),
        "value",
        F.lit(None).cast("string").alias("qualifiers"),
        F.lit(41.0).alias("latitude"),
        F.lit(-85.0).alias("longitude"),
        F.lit("Approved").alias("approval_status"),
        F.col("m").cast("timestamp").alias("last_modified"),
        F.year(F.col("t").cast(datetime_type(service))).cast("string").alias("year"),
    )


def brute_latest(rows):
    """The latest copy of each (site, parameter, second) among tuples, in plain Python."""
    best = {}
    for site, param, time, value, modified in rows:
        key = (site, param, time[:19])
        rank = (modified or "", value)
        if key not in best or rank > best[key]:
            best[key] = rank
    return {key: rank[1] for key, rank in best.items()}
