"""Rounds over chains of pages must not gather tables in the driver."""

from pyspark.sql import functions as F

from riverlake.sources import pages


def test_rounds_do_not_broadcast(spark, monkeypatch):
    plans, kept = [], pages._kept

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(pages, "_kept", seen)
    links = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "gone"), ("x", "y"), ("y", "x"), ("d", "x"), ("p", "q"), ("q", "p")],
        "own string, following string",
    )
    landed = links.select(
        F.array(*[F.struct(F.lit(r).alias("rel"), F.col(c).alias("href")) for r, c in (("self", "own"), ("next", "following"))]).alias("links")
    )
    walked = {r.url: (r.last_url, r.steps, r.missing_url, r.loops) for r in pages.walk_chains(landed).collect()}
    assert walked["a"] == ("c", 2, "gone", False) and walked["d"] == (None, None, None, True)
    unreached = pages.unreached_pages(landed)
    assert sorted(r.url for r in unreached.collect()) == ["p", "q"]
    plans.append(unreached._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 3
    assert not any("Broadcast" in p for p in plans)
