"""What the physical plans must and must not contain."""

import re

import pytest

from riverlake.checks.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"

# The only steps in Python are hashes: of files, and running ones over sorted file lines.
HASHING = {"content_hash", "manifest_build", "verify_report", "file_hashes", "verify_tampered"}
# These write before they return; their plans are those of reading back.
WRITING = {"publish_roundtrip", "stream_ingest", "landed_load", "single_roundtrip", "basin_csv"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WRITING))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    python = set(re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", plan))
    assert python <= ({"MapInArrow"} if name in HASHING else set())


@pytest.mark.parametrize(
    "name,columns",
    [
        ("site_list", {"l_suppkey", "user_id"}),
        ("distinct_sites", {"l_suppkey"}),
        ("lake_max_date", {"datetime", "path"}),
        ("lake_site_list", {"latitude", "longitude"}),
        ("lake_layout", {"qualifiers"}),
        ("content_hash", {"doc_id", "text", "source"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    plan = all_queries()[name](spark, SF_DIR)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",") if field}
    assert read == columns


@pytest.mark.parametrize("name,shuffles", [("daily_latest", 1), ("daily_filtered", 2), ("parse_readings", 0),
                                           ("basin_area", 0), ("sites_geojson", 2), ("content_hash", 1),
                                           ("readings_page", 1)])
def test_number_of_shuffles(spark, name, shuffles):
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    assert len(re.findall(r"\bExchange (?:hash|range|Single)", plan)) == shuffles


@pytest.mark.parametrize("name", ["daily_latest", "continuous_latest", "lake_filtered", "provenance"])
def test_copies_are_dropped_before_the_shuffle(spark, name):
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    before = plan.split("WindowGroupLimit")
    assert len(before) == 3 and "Partial" in before[2]
    assert "Exchange" in before[1]
