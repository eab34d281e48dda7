"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlake.llm.rows import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for each id in a link.

    Every step sends each neighbour of a node to the least node around it, so a component
    becomes a star around its least id in a number of rounds that grows with the logarithm of
    its size. A node's neighbours are never gathered: only their minimum is, with partial sums.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        following = stored(small, "edges")
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            break
        edges = following
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
