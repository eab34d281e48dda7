"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables and BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from riverlake.checks import adapters
from riverlake.checks.queries import all_queries, lake_of
from riverlake.operators import versions
from riverlake.operators.readings import ReadingFilter
from riverlake.schemas import CONTINUOUS
from riverlake.session import configure, scratch_dir
from riverlake.sources import lake

HEADLINES = [
    "daily_filtered",
    "continuous_filtered",
    "daily_latest",
    "site_list",
    "page_count",
    "parse_readings",
    "site_metadata",
    "basin_area",
    "content_hash",
    "version_history",
    "provenance",
    # From a lake that the first of them writes.
    "lake_filtered",
    "single_site",
    "lake_max_date",
]
REPEATS = 3


def drain(df: DataFrame) -> None:
    """Compute every column of every row without sending anything to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    argparse.ArgumentParser(description=__doc__).parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riverlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = all_queries()

    seconds: dict[str, float] = {}
    for name in HEADLINES:
        runs = [timed(lambda: drain(queries[name](spark, sf_dir))) for _ in range(REPEATS)]
        seconds[name] = round(min(runs), 3)

    readings = adapters.continuous(spark, sf_dir)
    written: list[int] = []

    def append() -> None:
        written.append(
            lake.append_readings(readings, scratch_dir(spark, "bench-lake"), CONTINUOUS)
        )

    seconds["lake_append"] = round(min(timed(append) for _ in range(REPEATS)), 3)
    root, target = lake_of(spark, sf_dir), scratch_dir(spark, "bench-published")
    names: list[str] = []

    def publish() -> None:
        names.append(versions.publish(spark, root, target, ReadingFilter(), "flow").first().dir_name)

    seconds["publish"] = round(min(timed(publish) for _ in range(REPEATS)), 3)

    def verify() -> None:
        drain(versions.verify_published(spark, target, "flow", names[-1]))

    seconds["verify"] = round(min(timed(verify) for _ in range(REPEATS)), 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "lake_append_rows_per_sec": round(written[-1] / seconds["lake_append"]),
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
