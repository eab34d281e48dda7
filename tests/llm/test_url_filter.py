import pytest
from pyspark.sql import functions as F

from riverlake.llm.queries import URL_RULES
from riverlake.llm.url_filter import DAMPING, host_links, judge_urls, spread

SCHEMA = "page_id long, url string, html string"


def page(i, url, *links):
    return (i, url, "".join(f'<a href="{x}">x</a>' for x in links))


def judged(df, rules=URL_RULES):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1?x#y", None),
        (2, "https://example.org/en/17", None),
        (3, "https://notexample.org/es/", None),
        (4, "ftp://x.com/fr/a://b/de/", None),
        (5, "http://com/de/", None),
        (6, "http://org", None),
        (7, "http://org?/es/", None),
        (8, None, "<a href='http://org/'>"),
        (9, "no url", None),
        (10, "://example.org/es/#", None),
        (11, "http://x.net:80/é\n/q?", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("host", "rule", "rank")})
    assert judged(df) == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/17", "example.org/en/1", "block"),
        3: ("notexample.org", "/es/", "org/", "allow"),
        4: ("x.com", "/fr/a://b/de/", "com/fr/", "allow"),
        5: ("com", "/de/", "com/de/", "block"),
        6: ("org", "", None, "allow"),
        7: ("org", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("example.org", "/es/", "example.org/es/", "block"),
        11: ("x.net:80", "/é\n/q", None, "allow"),
    }


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    rows = [
        page(1, "http://good.org/a", "http://friend.net/", "//friend.net/b", "/own"),
        page(2, "http://bad.com/de/a", "http://victim.net/"),
        page(3, "http://farm.net/", "http://bad.com/x", "http://bad.com/y", "http://victim.net/"),
        page(4, "http://friend.net/", "http://victim.net/"),
        page(5, "http://victim.net/"),
        page(6, "http://alone.net/"),
    ]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    verdicts = {i: v[3] for i, v in judged(df).items()}
    assert verdicts == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_spread_equals_plain_iteration(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "d", 5.0), ("d", "c", 1.0), ("d", "a", 3.0)]
    seeds = {"a": 0.75, "c": 0.25}
    start = {k: v * (1 - DAMPING) for k, v in seeds.items()}
    rank = dict(start)
    total = {x: sum(n for a, _, n in links if a == x) for x, _, _ in links}
    for _ in range(300):
        after = dict(start)
        for a, b, n in links:
            after[b] = after.get(b, 0) + rank.get(a, 0) * n / total[a] * DAMPING
        rank = after
    got = spread(
        spark.createDataFrame(links, "a string, b string, n double"),
        spark.createDataFrame(list(seeds.items()), "host string, seed double"),
    )
    assert {r.host: r["rank"] for r in got.collect()} == pytest.approx(rank)


def test_a_long_chain_is_followed_to_its_end(spark):
    rows = [page(i, f"http://h{i}.net/", f"http://h{i + 1}.net/") for i in range(15)]
    rows += [page(15, "http://h15.net/", "http://bad.com/"), page(16, "http://bad.com/de/")]
    rows += [page(17, "http://far.net/", "http://h0.net/", "http://far.net/x")]
    found = judged(spark.createDataFrame(rows, SCHEMA))
    assert {v[3] for v in found.values()} == {"block"} and len(found) == 18


def test_a_long_page(spark):
    html = "x " * 200_000 + "<a href='http://bad.com/'>" + " y" * 200_000
    rows = [(1, "http://farm.net/", html), page(2, "http://bad.com/de/")]
    assert judged(spark.createDataFrame(rows, SCHEMA))[1][3] == "block"


def test_links_of_pages(spark):
    df = spark.createDataFrame([page(1, "http://a.org/", "HTTP://B.org/x", "/y", "http://a.org/z", "#")], SCHEMA)
    assert [tuple(r) for r in host_links(df, "url", "html").collect()] == [("a.org", "b.org", 1.0)]


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], SCHEMA)) == {}
