"""URL filters: longest-prefix rules, then trust and distrust along links between hosts.

A rule names a host and the beginning of a path; it fits that host and all its subdomains, and
the longest one that fits wins. Urls without a rule are judged by their host: personalised
PageRank spreads trust from hosts with allowed pages along links, and distrust from hosts with
blocked pages against them, to hosts that link there. A host with more distrust than trust is
blocked, one with no more of it is allowed.

Links of pages are counted per pair of hosts before anything else, with partial sums, so the
graph has a row per pair and a host with a third of all pages costs no more than another.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; as
no link leads to it, it is allowed. A null page has no links, and one of any length is searched
whole, in its row. Repeated rows give equal rows, and their links count each time. A host with as
much distrust as trust is allowed. An empty table gives no rows. Extra columns are not read,
whatever their names. Rules of the same length that fit are taken by name. A user or
port before or after a host is part of it, as in the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlake.llm.rows import stored

DAMPING = 0.85
TOLERANCE = 1e-12  # growth of all ranks together in a round
STORE_EVERY = 5
MARGIN = 1.0  # of distrust over trust that blocks a host

Rule = tuple[str, str, str]  # allow or block, host, beginning of the path

_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule and verdict of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b, n): how often pages of host a link to host b, itself not counted."""
    links = pages.select(
        host_of(F.col(url_col)).alias("a"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("link"),
    )
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(
        F.col("link")
    )
    return (
        links.select("a", host_of(target).alias("b"))
        .where("a <> b and a <> '' and b <> ''")
        .groupBy("a", "b")
        .agg(F.count("*").cast("double").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank (host, rank) from ``seeds`` (host, seed), along links (a, b, n).

    Each round keeps ``1 - DAMPING`` for the seeds and passes the rest on by the links' share.
    From zero, ranks only grow from round to round, so their sum and the number of hosts with a
    rank tell what is still to come: rounds go on until no host is newly reached and the sum
    grows by less than ``TOLERANCE`` a round. Ranks below what a double can hold are zero.
    """
    out = links.groupBy("a").agg(F.sum("n").alias("total"))
    shares = stored(
        links.join(out, "a").select("a", "b", (F.col("n") / F.col("total")).alias("share")),
        "host-shares",
    )
    start = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
    if shares.isEmpty():
        return start
    start = stored(start, "host-seeds")
    ranks, before = start, (0, 0.0)
    while True:
        for _ in range(STORE_EVERY):
            passed = ranks.join(shares, ranks["host"] == shares["a"]).select(
                F.col("b").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank")
            )
            ranks = passed.union(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = stored(ranks, "host-ranks")
        reached = F.count_if(F.col("rank") > 0).alias("hosts")
        row = ranks.agg(reached, F.coalesce(F.sum("rank"), F.lit(0.0)).alias("sum")).first()
        if row.hosts == before[0] and row["sum"] - before[1] < TOLERANCE * STORE_EVERY:
            return ranks
        before = (row.hosts, row["sum"])


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per row: id, host, path, the rule that fits, the verdict, and the host's trust and distrust."""
    placed = stored(
        pages.select(
            F.col(id_col),
            host_of(F.col(url_col)).alias("host"),
            path_of(F.col(url_col)).alias("path"),
        ).withColumn("r", rule_for(F.col("host"), F.col("path"), rules)),
        "urls",
    )
    links = stored(host_links(pages, url_col, html_col), "host-links")
    ruled = (
        placed.where("r is not null")
        .groupBy("host")
        .agg(
            F.count_if(F.col("r.verdict") == "allow").alias("allow"),
            F.count_if(F.col("r.verdict") == "block").alias("block"),
        )
    )
    sums = ruled.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()

    def seeds(verdict: str) -> DataFrame:
        weight = F.col(verdict) / F.lit(float(sums[verdict] or 1))
        return ruled.where(F.col(verdict) > 0).select("host", weight.alias("seed"))

    trust = spread(links, seeds("allow")).withColumnRenamed("rank", "trust")
    against = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = spread(against, seeds("block")).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full").select(
        "host",
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
    judged = placed.join(hosts, "host", "left")
    trusted, blamed = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(blamed > trusted * MARGIN, "block").otherwise("allow")
    return judged.select(
        id_col,
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), by_host).alias("verdict"),
        trusted.alias("trust"),
        blamed.alias("distrust"),
    )
