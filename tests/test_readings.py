import random

import pytest
from pyspark.sql import functions as F

from riverlake.operators import readings as r
from riverlake.operators.readings import ReadingFilter
from tests.helpers import brute_latest, readings


def values(df):
    return sorted(row.value for row in df.collect())


def test_latest_copy_is_kept(spark):
    revisions = [("2023-09-05", 7.5), ("2023-11-20", 6.25), ("2023-10-01", 8.0)]
    rows = [("USGS-8", "00065", "2023-08-14", value, changed) for changed, value in revisions]
    rows.append(("USGS-9", "00065", "2023-08-14", -1.5, "2023-08-15"))
    assert values(r.keep_latest(readings(spark, rows), "daily")) == [-1.5, 6.25]


def test_unknown_modification_time_ranks_last(spark):
    df = readings(
        spark,
        [("s", "p", "2024-01-01", 9.0, None), ("s", "p", "2024-01-01", 1.0, "1970-01-01")],
    )
    assert values(r.keep_latest(df, "daily")) == [1.0]


def test_one_second_is_one_time(spark):
    rows = [
        ("s", "p", "2024-01-01 05:15:00.000250", 1.0, "2024-02-01"),
        ("s", "p", "2024-01-01 05:15:00.000900", 2.0, "2024-02-02"),
        ("s", "p", "2024-01-01 05:15:01.000000", 3.0, "2024-02-01"),
    ]
    assert values(r.keep_latest(readings(spark, rows, "continuous"), "continuous")) == [2.0, 3.0]


@pytest.mark.parametrize("seed", range(3))
def test_latest_against_brute_force_with_a_hot_key(spark, seed):
    dice = random.Random(seed)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        time = f"2024-01-01 00:00:{0 if hot else dice.randrange(60):02d}.{dice.randrange(10**6):06d}"
        site = "hot" if hot else f"s{dice.randrange(5)}"
        modified = dice.choice([None, f"2024-02-{dice.randrange(1, 29):02d} 00:00:00"])
        rows.append((site, "p", time, float(i), modified))
    df = readings(spark, rows, "continuous").repartition(6)
    kept = r.keep_latest(df, "continuous")
    found = {
        (x.site_no, x.param_cd, x.second): x.value
        for x in kept.withColumn(
            "second", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
        ).collect()
    }
    assert found == brute_latest(rows)


def test_choice_among_equals_does_not_depend_on_order(spark):
    rows = [("s", "p", "2024-01-01", float(v), "2024-02-01") for v in range(50)]
    for n in (1, 3, 7):
        assert values(r.keep_latest(readings(spark, rows).repartition(n), "daily")) == [49.0]


def test_end_day_counts_whole(spark):
    rows = [
        ("s", "00060", "2024-01-02 23:59:59", 1.0),
        ("s", "00060", "2024-01-03 00:00:00", 2.0),
        ("s", "00060", "2023-12-31 23:59:59", 3.0),
    ]
    wanted = ReadingFilter(service="continuous", start="2024-01-01", end="2024-01-02")
    assert values(r.matching(readings(spark, rows, "continuous"), wanted)) == [1.0]


def test_filter_combines(spark):
    rows = [
        ("a", "00060", "2023-12-31", 1.0),
        ("a", "00060", "2024-01-01", 2.0),
        ("a", "00065", "2024-01-01", 3.0),
        ("b", "00060", "2024-06-30", 4.0),
        ("c", "00060", "2024-06-30", 5.0),
    ]
    df = readings(spark, rows)
    assert values(r.matching(df, ReadingFilter())) == [1.0, 2.0, 4.0, 5.0]
    assert values(r.matching(df, ReadingFilter(sites=("a", "b"), start="2024-01-01"))) == [2.0, 4.0]
    assert values(r.matching(df, ReadingFilter(start="", end="2024-01-01"))) == [1.0, 2.0]
    assert values(r.matching(df, ReadingFilter(param_cd="00065"))) == [3.0]
    assert values(r.matching(df, ReadingFilter().only("c"))) == [5.0]


def test_unknown_sites_are_passed_over(spark):
    df = readings(spark, [(s, "00060", "2024-01-01", float(i)) for i, s in enumerate("abc")])
    assert values(r.matching(df, ReadingFilter(sites=("a", "c", "zz")))) == [0.0, 2.0]


@pytest.mark.parametrize("text", ["yesterday", "2024-02-30"])
def test_bad_filter_date(spark, text):
    with pytest.raises(ValueError, match="end date .* is not"):
        r.matching(readings(spark, []), ReadingFilter(end=text))


def test_order(spark):
    rows = [("b", "p", "2024-01-01", 3.0), ("a", "p", "2024-01-02", 2.0), ("a", "p", "2024-01-01", 1.0)]
    assert [x.value for x in r.in_order(readings(spark, rows), "daily").collect()] == [1.0, 2.0, 3.0]


def test_wire_form_and_back(spark):
    rows = [("s", "p", "2024-01-01 05:15:00.9", 1.0, "2024-02-01 00:00:00.5"), ("s", "p", "2024-01-01", 2.0)]
    df = readings(spark, rows, "continuous")
    wire = {x.value: x for x in r.to_wire(df, "continuous").collect()}
    assert wire[1.0].datetime == "2024-01-01T05:15:00Z"
    assert wire[1.0].last_modified == "2024-02-01T00:00:00.500000Z"
    assert (wire[2.0].last_modified, wire[1.0].service) == ("", "continuous")
    back = r.from_wire(r.to_wire(df, "continuous"), "continuous")
    assert sorted(back.collect()) == sorted(r.as_exported(df, "continuous").collect())
    daily = readings(spark, [("s", "p", "2024-01-01", 1.0)])
    assert r.to_wire(daily, "daily").first().datetime == "2024-01-01"
    assert r.from_wire(r.to_wire(daily, "daily"), "daily").collect() == r.as_exported(daily, "daily").collect()


def test_bad_wire_time_fails(spark):
    wire = r.to_wire(readings(spark, [("s", "p", "2024-01-01", 1.0)]), "daily")
    with pytest.raises(Exception, match="cannot read time"):
        r.from_wire(wire.withColumn("datetime", F.lit("x")), "daily").select("value").collect()


@pytest.mark.parametrize("n,pages", [(0, 1), (100, 1), (101, 2)])
def test_page_count(spark, n, pages):
    df = spark.range(n)
    assert tuple(r.page_count(df).first()) == (n, pages)


def test_pages_follow_each_other(spark):
    days = spark.range(250).select(
        F.lit("s").alias("site_no"),
        F.lit("p").alias("param_cd"),
        F.date_format(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias(
            "datetime"
        ),
        F.col("id").cast("double").alias("value"),
        F.lit("").alias("approval_status"),
    )
    whole = days.unionByName(days.withColumn("site_no", F.lit("t")))
    numbered = [row for k in range(6) for row in r.page(whole, k).collect()]
    assert len(numbered) == len(set(numbered)) == 500
    walked, step = [], r.page(whole, 0).collect()
    while step:
        walked += step
        step = r.page_after(whole, step[-1].site_no, step[-1].datetime, step[-1].param_cd).collect()
    assert walked == numbered


@pytest.mark.parametrize("shallow", [0, 150])
def test_deep_pages_equal_a_sort_of_all(spark, monkeypatch, shallow):
    monkeypatch.setattr(r, "SHALLOW_ROWS", shallow)
    rows = [
        (f"s{i % 7 if i % 3 else 3}", f"p{i % 2}", f"2024-01-{1 + i % 5:02d}T00:{i // 60:02d}:{i % 60:02d}Z", float(i), "")
        for i in range(730)
    ]
    df = spark.createDataFrame(rows, "site_no string, param_cd string, datetime string, value double, approval_status string")
    ordered = sorted(rows, key=lambda x: (x[0], x[2], x[1]))
    for number in (0, 1, 2, 4, 7, 8, 50):
        assert [tuple(x) for x in r.page(df, number).collect()] == ordered[100 * number :][:100]
    assert r.page(df.limit(0), 3).collect() == []


def test_chart_series(spark):
    rows = spark.createDataFrame(
        [("b", "2024-01-01", 1.0), ("a", "2024-01-02T00:00:01Z", 2.0), ("a", "2024-01-01", 3.0), ("a", "?", 4.0)],
        "site_no string, datetime string, value double",
    )
    points = r.chart_series(rows).withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss"))
    assert [tuple(p) for p in points.collect()] == [
        ("a", "2024-01-01 00:00:00", 3.0),
        ("a", "2024-01-02 00:00:01", 2.0),
        ("b", "2024-01-01 00:00:00", 1.0),
    ]


def test_distinct_values_skip_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "s string")
    assert sorted(x.s for x in r.distinct_values(df, "s").collect()) == ["a", "b"]
