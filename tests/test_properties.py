"""Expressions against independent plain Python, on many made-up inputs at once."""

import datetime as dt
import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverlake.functions import parsing
from riverlake.functions.wire import fixed_decimals
from riverlake.plans.requests import with_windows

FEW = settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def parsed(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def plain_number(text):
    if text != text.strip() or "_" in text or not text.isascii():
        return None
    try:
        return float(text)
    except ValueError:
        return None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


pieces = st.sampled_from(
    ["1", "20", ".", "-", "+", "e", "E", "5", "0", "inf", "NaN", "Infinity", "d", "f", " ", "_", "x"]
)


@FEW
@given(st.lists(st.lists(pieces, max_size=5).map("".join), min_size=300, max_size=400))
def test_number(spark, texts):
    found = parsed(spark, texts, parsing.number)
    wrong = [(t, f) for t, f in zip(texts, found) if not same(f, plain_number(t))]
    assert wrong == []


def plain_date(text):
    try:
        return dt.date.fromisoformat(text) if len(text) == 10 and text[4] == "-" == text[7] else None
    except ValueError:
        return None


numbers = st.integers(0, 40).map(lambda n: f"{n:02d}")


@FEW
@given(
    st.lists(
        st.tuples(st.sampled_from(["2024", "1900", "24", "0001"]), numbers, numbers).map("-".join),
        min_size=200,
        max_size=300,
    )
)
def test_date(spark, texts):
    assert parsed(spark, texts, parsing.local_date) == [plain_date(t) for t in texts]


def test_instant(spark):
    dice = random.Random(3)
    texts, expected = [], []
    for _ in range(500):
        zone = dice.choice(["Z", "z", "+00:00", "-05:00", "+05:30", "-11:15"])
        micros = dice.choice(["", ".5", ".000001", ".123456"])
        moment = dt.datetime(1990, 1, 1) + dt.timedelta(seconds=dice.randrange(2**30))
        text = moment.isoformat(sep=dice.choice("Tt ")) + micros + zone
        texts.append(text)
        value = dt.datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
        expected.append(value.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"))
    found = parsed(
        spark, texts, lambda t: F.date_format(parsing.instant(t), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    assert found == expected


def test_instants_that_are_refused(spark):
    texts = [
        "2024-01-01",
        "2024-01-01T00:00:00",
        "2024-01-01T00:00Z",
        "2024-01-01T24:00:00Z",
        "2024-01-01T00:00:00+0500",
        "2024-01-01T00:00:00 Z",
        "2024-02-30T00:00:00Z",
        "2024-1-01T00:00:00Z",
        "x2024-01-01T00:00:00Z",
        "2024-01-01T00:00:00Z\n",
    ]
    assert parsed(spark, texts, parsing.instant) == [None] * len(texts)


def test_fixed_decimals(spark):
    dice = random.Random(6)
    values = [2.0005, 2.5, 0.125, -2.0005, 1e20, 123456789.0005, math.inf, -math.inf]
    values += [round(dice.uniform(-1e4, 1e4), 4) for _ in range(2000)]
    values += [dice.randrange(-(10**7), 10**7) / 16 for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for places in (0, 3, 4):
        rows = df.select("i", fixed_decimals(F.col("v"), places).alias("t")).orderBy("i").collect()
        assert [r.t for r in rows] == [f"{v:.{places}f}" for v in values]


def test_windows(spark):
    dice = random.Random(4)
    ranges, expected = [], set()
    for i in range(200):
        start = dt.date(1950, 1, 1) + dt.timedelta(dice.randrange(25000))
        end = start + dt.timedelta(dice.choice([0, 1, 1094, 1095, 1096, dice.randrange(9000)]))
        ranges.append((f"s{i}", start, end))
        while start <= end:
            last = min(start + dt.timedelta(1094), end)
            expected.add((f"s{i}", start, last, f"{start}T00:00:00Z/{last}T23:59:59Z"))
            start = last + dt.timedelta(1)
    df = spark.createDataFrame(ranges, "site_no string, start date, end date")
    found = [tuple(r) for r in with_windows(df, "continuous").collect()]
    assert len(found) == len(expected) and set(found) == expected
