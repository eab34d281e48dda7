import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riverlake import schemas
from riverlake.operators import readings as r
from riverlake.operators.readings import ReadingFilter
from riverlake.session import scratch_dir
from riverlake.sources import lake
from tests.helpers import readings

DAILY = [
    ("USGS-1", "00060", "2023-12-31", 1.0),
    ("USGS-1", "00060", "2024-01-01", 2.0),
    ("USGS-1", "00065", "2024-01-01", 3.0),
    ("USGS-2", "00060", "2024-05-01", 4.0),
]


@pytest.fixture
def root(spark):
    root = scratch_dir(spark, "test-lake")
    lake.append_readings(readings(spark, DAILY), root, "daily")
    return root


def test_stored_schema_leaves_out_what_the_path_gives():
    assert schemas.stored_schema("daily").fieldNames() == [
        "datetime",
        "value",
        "qualifiers",
        "latitude",
        "longitude",
        "approval_status",
        "last_modified",
    ]
    assert schemas.lake_schema("daily").fieldNames()[-3:] == ["site_no", "param_cd", "year"]


def test_layout():
    assert lake.service_root("lake/", "continuous") == "lake/service=continuous"
    with pytest.raises(ValueError, match="unknown service"):
        lake.service_root("lake", "hourly")


def test_append_counts_and_keeps_copies(spark, root):
    assert lake.append_readings(readings(spark, DAILY[:2]), root, "daily") == 2
    assert lake.append_readings(readings(spark, []), root, "daily") == 0
    table = lake.read_service(spark, root, "daily")
    assert table.count() == 6
    assert r.keep_latest(table, "daily").count() == 4


def test_path_columns_stay_text(spark, root):
    table = lake.read_service(spark, root, "daily")
    assert dict(table.dtypes)["param_cd"] == dict(table.dtypes)["year"] == "string"
    assert {x.param_cd for x in table.collect()} == {"00060", "00065"}


def test_path_wins_over_a_column_in_the_file(spark):
    root = scratch_dir(spark, "test-lake")
    folder = f"{root}/service=daily/site_no=USGS-7/param_cd=00060/year=2024"
    stored = readings(spark, [("other", "99999", "2024-01-01", 1.0)]).drop("year")
    stored.write.parquet(folder)
    row = lake.read_service(spark, root, "daily").first()
    assert (row.site_no, row.param_cd, row.year) == ("USGS-7", "00060", "2024")


def test_year_of_an_instant_is_the_utc_year(spark):
    root = scratch_dir(spark, "test-lake")
    lake.append_readings(
        readings(spark, [("s", "p", "2023-12-31 23:30:00-05:00", 1.0)], "continuous"),
        root,
        "continuous",
    )
    assert lake.read_service(spark, root, "continuous").first().year == "2024"


def test_missing_service_reads_as_empty(spark, root):
    lake.register_lake(spark, root)
    assert spark.table("daily").count() == 4
    assert spark.table("continuous").count() == 0
    assert dict(spark.table("continuous").dtypes)["datetime"] == "timestamp"
    assert lake.latest_dates(spark, root, "continuous").count() == 0


def test_narrowed_read_gives_the_same(spark, root):
    for sites in (("USGS-1",), ("USGS-1", "USGS-404"), ("USGS-404",), ("odd name/é",), ()):
        wanted = ReadingFilter(sites=sites)
        narrow = r.filtered_readings(spark, root, wanted)
        whole = r.latest_matching(lake.read_service(spark, root, "daily"), wanted)
        assert sorted(narrow.collect()) == sorted(whole.collect())


def test_names_that_a_path_spells_differently(spark):
    root, odd = scratch_dir(spark, "test-lake"), "a:b=c/d [e]{f}*é%20"
    lake.append_readings(readings(spark, [(odd, "00060", "2024-01-01", 1.0)]), root, "daily")
    found = r.filtered_readings(spark, root, ReadingFilter(sites=(odd,))).collect()
    assert [(x.site_no, x.value) for x in found] == [(odd, 1.0)]
    for options in ({}, {"sites": [odd]}):
        dates = lake.latest_dates(spark, root, "daily", "00060", **options).collect()
        assert [(x.site_no, str(x.max_date)) for x in dates] == [(odd, "2024-01-01")]


def test_filters_prune_folders_and_reach_the_files(spark, root):
    wanted = ReadingFilter(start="2024-01-01", end="2024-12-31")
    plan = r.filtered_readings(spark, root, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "param_cd" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(datetime,2024-01-01)" in plan
    assert "WindowGroupLimit" in plan


def test_latest_dates(spark, root):
    rows = lake.latest_dates(spark, root, "daily").collect()
    assert {(x.site_no, x.param_cd): x.max_date for x in rows} == {
        ("USGS-1", "00060"): dt.date(2024, 1, 1),
        ("USGS-1", "00065"): dt.date(2024, 1, 1),
        ("USGS-2", "00060"): dt.date(2024, 5, 1),
    }
    only = lake.latest_dates(spark, root, "daily", "00065").collect()
    assert [x.site_no for x in only] == ["USGS-1"]
    for param in (None, "00060"):
        some = lake.latest_dates(
            spark, root, "daily", param, sites=["USGS-2", "USGS-404"]
        )
        assert [tuple(x) for x in some.collect()] == [("USGS-2", "00060", dt.date(2024, 5, 1))]
    assert lake.latest_dates(spark, root, "daily", "00060", sites=["USGS-404"]).count() == 0


def test_latest_dates_of_series_that_ended_at_different_times(spark):
    root = scratch_dir(spark, "test-lake")
    rows = [(s, "00060", f"{y}-0{m}-01", 1.0) for s, y in (("a", 1950), ("b", 2024)) for m in (1, 3)]
    rows += [("b", "00060", "1950-09-01", 1.0), ("b", "00060", "2001-09-01", 1.0)]
    lake.append_readings(readings(spark, rows), root, "daily")
    dates = {x.site_no: str(x.max_date) for x in lake.latest_dates(spark, root, "daily").collect()}
    assert dates == {"a": "1950-03-01", "b": "2024-03-01"}


def test_latest_dates_open_the_footers_of_the_newest_year_only(spark):
    root = scratch_dir(spark, "test-lake")
    rows = [("a", "p", f"{y}-02-0{d}", 1.0) for y in (1999, 2000, 2024) for d in (1, 2)]
    lake.append_readings(readings(spark, rows), root, "daily")
    lake.append_readings(readings(spark, [("a", "p", "2024-01-15", 1.0)]), root, "daily")
    series = Path(root) / "service=daily" / "site_no=a" / "param_cd=p"
    for file in [*(series / "year=2000").glob("*.parquet"), *(series / "year=1999").glob("*.parquet")]:
        file.write_bytes(b"not read")
    (series / "year=2024" / "_temporary").mkdir()
    (series / "year=2024" / "_temporary" / "part-0.parquet").write_bytes(b"not read")
    (series / "year=2025").mkdir()
    pq.write_table(
        pq.read_table(next((series / "year=2024").glob("*.parquet"))).slice(0, 0),
        series / "year=2025" / "empty.parquet",
    )
    assert [str(x.max_date) for x in lake.latest_dates(spark, root, "daily").collect()] == ["2024-02-02"]


def test_latest_dates_take_no_call_to_the_jvm_for_each_site(spark, monkeypatch):
    from py4j.java_gateway import GatewayClient

    root, calls, send = scratch_dir(spark, "test-lake"), [], GatewayClient.send_command

    def calls_for(n):
        rows = [(f"s{n}-{i}", "p", "2024-02-01", 1.0) for i in range(n)]
        lake.append_readings(readings(spark, rows), f"{root}/{n}", "daily")
        with monkeypatch.context() as patched:
            patched.setattr(GatewayClient, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
            found = lake.latest_dates(spark, f"{root}/{n}", "daily")
        made = len(calls)
        calls.clear()
        assert {x.site_no for x in found.collect()} == {f"s{n}-{i}" for i in range(n)}
        return made

    assert calls_for(60) < calls_for(2) + 30


def test_a_lake_is_not_listed_in_a_task_for_each_site(spark):
    root = scratch_dir(spark, "test-lake")
    rows = [(f"s{i}", "p", "2024-02-01", 1.0) for i in range(60)]
    lake.append_readings(readings(spark, rows), root, "daily")
    before = spark.conf.get(lake._LISTING)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        table = lake.read_service(spark, root, "daily")
    finally:
        sc._jsc.clearJobGroup()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    stages = [tracker.getStageInfo(s) for job in jobs for s in job.stageIds]
    assert stages and max(s.numTasks for s in stages) <= 8
    assert table.count() == 60 and spark.conf.get(lake._LISTING) == before


def test_latest_dates_need_statistics(spark):
    root = scratch_dir(spark, "test-lake")
    folder = f"{root}/service=daily/site_no=a/param_cd=p/year=2024"
    row = readings(spark, [("a", "p", "2024-01-01", 1.0)]).drop("year", "site_no", "param_cd")
    row.write.option("parquet.column.statistics.enabled", "false").parquet(folder)
    with pytest.raises(Exception, match="no statistics of datetime"):
        lake.latest_dates(spark, root, "daily").collect()


def test_latest_dates_of_instants_are_utc(spark):
    root = scratch_dir(spark, "test-lake")
    rows = [("s", "p", "2024-03-09 23:30:00-05:00", 1.0), ("s", "p", "2024-03-09 20:00:00+00:00", 1.0)]
    lake.append_readings(readings(spark, rows, "continuous"), root, "continuous")
    (row,) = lake.latest_dates(spark, root, "continuous").collect()
    assert str(row.max_date) == "2024-03-10"


def test_many_sites_keep_the_partition_filter(spark, root):
    wanted = ReadingFilter(sites=tuple(f"USGS-{i}" for i in range(5000)))
    plan = r.filtered_readings(spark, root, wanted)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1]
    assert "site_no" in filters.split("PushedFilters")[0]
    assert r.filtered_readings(spark, root, wanted).count() == 3


def test_append_leaves_about_one_file_a_series_and_splits_a_big_one(spark):
    root = scratch_dir(spark, "test-lake")
    many = spark.range(40_000).select(
        F.concat(F.lit("s"), F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 20).cast("string")).alias("site_no"),
        F.lit("00060").alias("param_cd"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("datetime"),
        F.lit(1.0).alias("value"),
    )
    full = readings(spark, [], "continuous")
    many = full.drop("year").unionByName(many, allowMissingColumns=True).fillna(
        {"latitude": 1.0, "longitude": 1.0, "approval_status": "Approved"}
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        assert lake.append_readings(many, root, "continuous") == 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = lake.read_service(spark, root, "continuous").inputFiles()
    hot = [f for f in files if "site_no=s0/" in f]
    assert len(files) <= 20 + 8 and len(hot) > 1


def test_failed_append_adds_nothing(spark, root):
    bad = readings(spark, DAILY).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        lake.append_readings(bad, root, "daily")
    assert lake.read_service(spark, root, "daily").count() == 4
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_hot_partition_is_split_over_tasks(spark):
    root = scratch_dir(spark, "test-lake")
    rows = spark.range(400_000).select(
        F.lit("hot").alias("site_no"),
        F.lit("p").alias("param_cd"),
        F.timestamp_seconds(F.col("id") + 1704067200).alias("datetime"),
        F.rand(1).alias("value"),
        F.sha2(F.col("id").cast("string"), 256).alias("qualifiers"),
        F.rand(2).alias("latitude"),
        F.rand(3).alias("longitude"),
        F.lit("").alias("approval_status"),
        F.current_timestamp().alias("last_modified"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        assert lake.append_readings(rows.repartition(8), root, "continuous") == 400_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    table = lake.read_service(spark, root, "continuous")
    assert table.count() == 400_000
    assert len(table.inputFiles()) > 1
    for path in table.inputFiles():
        times = pq.ParquetFile(path.removeprefix("file://")).read(["datetime"]).column(0)
        assert times.to_pylist() == sorted(times.to_pylist())


def test_stored_timestamps_have_statistics(spark, root):
    lake.append_readings(
        readings(spark, [("s", "p", "2024-01-01 00:00:00.25", 1.0)], "continuous"), root, "continuous"
    )
    (path,) = lake.read_service(spark, root, "continuous").inputFiles()
    file = pq.ParquetFile(path.removeprefix("file://"))
    column = file.metadata.row_group(0).column(0)
    assert column.path_in_schema == "datetime" and column.statistics.has_min_max
    assert str(file.schema_arrow.field("datetime").type) == "timestamp[us, tz=UTC]"
    assert column.compression == "ZSTD"


def test_export_keeps_all_nine_columns(spark):
    path = scratch_dir(spark, "test-export")
    df = readings(spark, DAILY)
    lake.write_export(df, path, "daily")
    back = lake.read_export(spark, path, "daily")
    assert back.columns == schemas.reading_schema("daily").fieldNames()
    assert sorted(back.collect()) == sorted(df.drop("year").collect())
    assert len(back.inputFiles()) == 1
