"""A lake whose folders are too many for the driver, read by tasks, against Spark's own reader."""

import datetime as dt
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

from riverlake.operators import readings as r
from riverlake.operators import sites, versions
from riverlake.operators.readings import ReadingFilter
from riverlake.schemas import stored_schema
from riverlake.session import scratch_dir
from riverlake.sources import lake, small_files
from tests.helpers import readings

ODD = "a:b=c/d [e]{f}*é%20"
DAILY = [
    *[(f"s{i}", p, f"{y}-0{m}-01", i + m / 10) for i in range(6) for p in ("00060", "00065") for y in (1999, 2004) for m in (1, 2)],
    ("s1", "00060", "1999-01-01", 7.0, "2020-01-01 10:00:00"),
    (ODD, "00060", "1500-03-01", 1.0, "1500-03-01 10:00:00"),
    (None, "00060", "2004-01-01", 2.0),
    ("s2", None, "2004-01-01", 3.0),
]


@pytest.fixture
def large(monkeypatch):
    """From here on lakes are read as if they were large."""
    return lambda: monkeypatch.setattr(lake, "FOLDERS_BY_SPARK", 0, raising=False)


@pytest.fixture
def root(spark):
    root = scratch_dir(spark, "test-large-lake")
    lake.append_readings(readings(spark, DAILY), root, "daily")
    lake.append_readings(readings(spark, DAILY[:9]), root, "daily")
    times = [(s, "00060", f"{d}.000250", v) for s, _, d, v, *_ in ((*x[:2], f"{x[2]} 23:30:00", x[3]) for x in DAILY[:9])]
    lake.append_readings(readings(spark, times, "continuous"), root, "continuous")
    return root


def rows(table):
    return sorted(map(tuple, table.collect()), key=repr)


def both_ways(large, make):
    """Rows and types of a table as Spark reads it, and as tasks do."""
    by_spark = make()
    held = rows(by_spark), [(n, t) for n, t in by_spark.dtypes]
    assert by_spark.inputFiles()
    large()
    by_tasks = make()
    assert by_tasks.inputFiles() == []  # the driver holds no name of a file
    return held, (rows(by_tasks), [(n, t) for n, t in by_tasks.dtypes])


@pytest.mark.parametrize("service", ["daily", "continuous"])
def test_rows_are_the_same(spark, root, large, service):
    before, after = both_ways(large, lambda: lake.read_service(spark, root, service))
    assert before == after and before[0]


@pytest.mark.parametrize(
    "wanted",
    [
        ReadingFilter(),
        ReadingFilter(start="1999-02-01", end="2004-01-31"),
        ReadingFilter(end="1999-12-31", param_cd="00065"),
        ReadingFilter(sites=(ODD, "s3", "s404")),
    ],
)
def test_filters_give_the_same(spark, root, large, wanted):
    before, after = both_ways(large, lambda: r.filtered_readings(spark, root, wanted))
    assert before == after and before[0]


def test_site_list_and_layout_are_the_same(spark, root, large):
    def layout():
        lake.register_lake(spark, root, ["qualifiers"])
        return spark.table("daily").groupBy("site_no", "param_cd", "year").count()

    assert set(lake.read_service(spark, root, "daily", columns=["latitude"]).columns) == {
        "latitude", "site_no", "param_cd", "year"
    }
    listed = rows(sites.list_sites(spark, root))
    before, after = both_ways(large, layout)
    assert before == after and rows(sites.list_sites(spark, root)) == listed
    assert spark.table("daily").columns == ["qualifiers", "site_no", "param_cd", "year"]


def test_a_published_version_is_the_same(spark, root, large):
    hashes = []
    for name in ("a", "b"):
        summary = versions.publish(spark, root, scratch_dir(spark, "published"), ReadingFilter(), name)
        hashes.append(summary.first().content_hash)
        large()
    assert hashes[0] == hashes[1]


def test_folders_that_the_filter_leaves_out_are_not_read(spark, root, large):
    large()
    series = Path(root) / "service=daily" / "site_no=s4"
    spoiled = [*series.glob("param_cd=00065/*/*.parquet"), *series.glob("*/year=2004/*.parquet")]
    assert spoiled
    for file in spoiled:
        file.write_bytes(b"not read")
    wanted = ReadingFilter(sites=("s4",), start="1999-01-01", end="1999-12-31")
    assert r.filtered_readings(spark, root, wanted).count() == 2


def test_files_of_other_writers(spark, root, large):
    """A column missing or too many, other names' case, INT96, an empty file, hidden ones, folders below a year."""
    folder = Path(root) / "service=daily" / "site_no=s0" / "param_cd=00060" / "year=1999"
    one = readings(spark, [("other", "99999", "1999-05-01", 5.0, "1999-05-02 10:00:00")]).drop("year")
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        one.withColumn("extra", F.lit(1)).drop("qualifiers").write.parquet(str(folder / "below"))
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", before)
    pq.write_table(pa.table({"DateTime": [dt.date(1999, 6, 1)], "Value": [6.0]}), folder / "cased.parquet")
    pq.write_table(pa.table({"unknown": [1, 2]}), folder / "unknown.parquet")
    (folder / "nothing.parquet").write_bytes(b"")
    (folder / "_hidden.parquet").write_bytes(b"not read")
    (folder / "_temporary").mkdir()
    (folder / "_temporary" / "part.parquet").write_bytes(b"not read")
    before, after = both_ways(large, lambda: lake.read_service(spark, root, "daily"))
    assert before == after
    assert [x for x in after[0] if x[0] == dt.date(1999, 6, 1)][0][1] == 6.0
    assert [x[7:] for x in after[0] if x[0] is None] == [("s0", "00060", "1999")] * 2


def test_what_has_no_place_in_a_lake_is_an_error(spark, root, large):
    (Path(root) / "service=daily" / "site_no=s0" / "notes").mkdir()
    large()
    with pytest.raises(Exception, match="not a partition folder of param_cd"):
        lake.read_service(spark, root, "daily").count()


def test_times_by_an_old_calendar_are_an_error(spark, root, large):
    folder = Path(root) / "service=daily" / "site_no=s0" / "param_cd=00060" / "year=1500"
    folder.mkdir()
    table = pa.table({"datetime": [dt.date(1500, 1, 1)]}).replace_schema_metadata({"org.apache.spark.version": "2.4.8"})
    pq.write_table(table, folder / "old.parquet")
    large()
    with pytest.raises(Exception, match="calendar of an old Spark"):
        lake.read_service(spark, root, "daily").count()


def test_a_large_file_comes_in_pieces(spark, tmp_path, monkeypatch):
    """Memory is that of a piece, and rows keep their places."""
    schema = pa.schema([("value", pa.int64())])
    path = tmp_path / "x.parquet"
    pq.write_table(pa.table({"value": range(50_000)}), path)
    store = LocalFileSystem()
    monkeypatch.setattr(small_files, "WHOLE_BYTES", 1000)
    pieces = list(small_files._file_rows(store, str(path), schema))
    assert len(pieces) > 4 and max(map(len, pieces)) <= small_files.READ_ROWS
    assert pa.Table.from_batches(pieces).column(0).to_pylist() == list(range(50_000))


def test_how_a_lake_is_read_follows_its_folders(spark, root, monkeypatch):
    assert lake.read_service(spark, root, "daily").inputFiles()
    monkeypatch.setattr(lake, "FOLDERS_BY_SPARK", 20, raising=False)
    assert lake.read_service(spark, root, "daily").inputFiles() == []  # some 26 series and years
    assert lake.read_service(spark, root, "daily", ["s1"]).inputFiles()
    assert lake.read_service(spark, root, "continuous").inputFiles()


def test_finding_sites_takes_no_call_to_the_jvm_for_each(spark, monkeypatch):
    from py4j.java_gateway import GatewayClient

    root, calls, send = scratch_dir(spark, "test-lake"), [], GatewayClient.send_command

    def calls_for(n):
        lake.append_readings(readings(spark, [(f"s{i}", "p", "2024-02-01", 1.0) for i in range(n)]), f"{root}/{n}", "daily")
        with monkeypatch.context() as patched:
            patched.setattr(GatewayClient, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
            table = lake.read_service(spark, f"{root}/{n}", "daily", ["s1"])
        made = len(calls)
        calls.clear()
        assert table.count() == 1
        return made

    assert calls_for(60) < calls_for(2) + 30


def test_a_small_file_has_no_dictionaries(spark, root):
    """They cost more, in bytes and in time, than they save in a few rows."""
    file = next((Path(root) / "service=daily").rglob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    for i, name in enumerate(stored_schema("daily").fieldNames()):
        assert group.column(i).path_in_schema == name and not group.column(i).has_dictionary_page
