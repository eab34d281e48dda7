import json

import pytest

from riverlake.operators.readings import ReadingFilter, query_readings
from riverlake.operators.sites import list_sites
from riverlake.plans.loading import export_landed, load_landed
from riverlake.plans.requests import plan_requests, requested_sites
from riverlake.session import scratch_dir
from riverlake.sources import lake
from tests.test_cleaning import feature


def land(path, *features, own="u1", following=None):
    links = [{"rel": "self", "href": own}]
    if following:
        links.append({"rel": "next", "href": following})
    path.write_text(json.dumps({"features": list(features), "links": links}))


def test_two_runs_with_resume_and_query(spark, tmp_path):
    root = scratch_dir(spark, "test-lake")
    first, second = tmp_path / "1", tmp_path / "2"
    first.mkdir(), second.mkdir()
    land(first / "a.json", feature(value="1"), own="u1", following="u2")
    land(first / "b.json", feature(value="2", time="2025-06-02"), own="u2")
    assert load_landed(spark, str(first), root, "daily") == 2

    sites = requested_sites(spark, "USGS-1, 2")
    known = lake.latest_dates(spark, root, "daily", "00060")
    plan = plan_requests(sites, "daily", "2020-01-01", "2025-07-01", known)
    assert {(r.site_no, r.datetime_range) for r in plan.collect()} == {
        ("USGS-1", "2025-06-02/2025-07-01"),
        ("USGS-2", "2020-01-01/2025-07-01"),
    }

    revised = feature(value="5", time="2025-06-02", last_modified="2025-07-02T00:00:00Z")
    land(second / "a.json", revised, feature(monitoring_location_id="USGS-2", value="7"))
    assert load_landed(spark, str(second), root, "daily") == 2
    rows = query_readings(spark, root, ReadingFilter()).collect()
    assert [(r.site_no, r.datetime, r.value) for r in rows] == [
        ("USGS-1", "2025-06-01", 1.0),
        ("USGS-1", "2025-06-02", 5.0),
        ("USGS-2", "2025-06-01", 7.0),
    ]
    assert [r.site_no for r in list_sites(spark, root).collect()] == ["USGS-1", "USGS-2"]


def test_gap_in_the_pages_is_an_error(spark, tmp_path):
    root = scratch_dir(spark, "test-lake")
    land(tmp_path / "a.json", feature(), following="u2")
    with pytest.raises(ValueError, match="u2 has not landed"):
        load_landed(spark, str(tmp_path), root, "daily")
    assert load_landed(spark, str(tmp_path), root, "daily", complete=False) == 1


def test_no_readings_is_an_error(spark, tmp_path):
    root = scratch_dir(spark, "test-lake")
    land(tmp_path / "a.json", feature(value=None))
    for action in (load_landed, export_landed):
        with pytest.raises(ValueError, match="no readings"):
            action(spark, str(tmp_path), root, "daily")


def test_export(spark, tmp_path):
    path = scratch_dir(spark, "test-export")
    land(tmp_path / "a.json", feature(), feature(time="2024-01-01"))
    assert export_landed(spark, str(tmp_path), path, "daily") == 2
    rows = lake.read_export(spark, path, "daily").collect()
    assert {(r.site_no, r.param_cd, r.value) for r in rows} == {("USGS-1", "00060", 1.5)}
