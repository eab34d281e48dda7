"""A Merkle manifest of a dataset: leaf hashes, a root per group, one root, and inclusion proofs.

Rows are leaves. The leaves of a group stand in order and every ``FANOUT`` consecutive nodes are
hashed into one until a single node, the group's root, is left; the roots of the groups, in their
order, give the root of the dataset in the same way.

The leaves of a group are dealt into partitions of ``FANOUT ** LOW_LEVELS`` consecutive ones. A
partition hashes its own subtree. Then partitions swap roots in a butterfly: in round ``r`` the
partitions that agree in all digits of their number (to the base ``FANOUT``) but digit ``r`` meet,
each with the root of its aligned subtree of ``FANOUT ** r`` partitions, and each hashes the
parent for itself. So ancestors are hashed by every partition below them, and after the last
round each partition holds all its upper siblings without a pass back down the tree. In the last
subtree of a level, which may have fewer partitions, each stands in for several. A round is a
shuffle of a short row per partition. Proofs and folded roots are then made within partitions.

Defined results: nulls in a leaf are ``-``, and a null group is one of its own, ahead of all
others. Within a group leaves go by the order column (null first), then by their hash; repeated
rows are leaves of their own with the same digests up to their place. A row of a null id is never
tampered with. An empty table gives no rows. A text of any length is hashed where it is and not
moved. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlake.llm.rows import stored

FANOUT = 16
LOW_LEVELS = 3  # levels within a partition

_STEP = "struct<place: int, siblings: array<string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sealed(*values: Column) -> Column:
    """SHA-256 in hex over the values, each as its length in bytes, a colon and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(framed, F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


# -- places ---------------------------------------------------------------------------------


def with_places(leaves: DataFrame, by: list[str]) -> DataFrame:
    """``leaves`` with ``at``, their place in their ``grp`` by the columns ``by``, and ``total``.

    Rows are sorted over all tasks by ranges; places follow from how many rows of the group
    the tasks before have, one short row per task and group.
    """
    ordered = leaves.repartitionByRange("grp", *by).sortWithinPartitions("grp", *by)
    line = F.monotonically_increasing_id()
    kept = stored(ordered.withColumn("line", line), "merkle-order")
    part = F.shiftright("line", 33)
    counts = kept.groupBy("grp", part.alias("part")).agg(
        F.count("*").alias("n"), F.min("line").alias("first")
    )
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "grp",
        "part",
        "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )
    return (
        kept.withColumn("part", part)
        .join(starts, ["grp", "part"])
        .withColumn("at", F.col("before") + F.col("line") - F.col("first"))
        .drop("line", "part", "first", "before")
    )


# -- trees ----------------------------------------------------------------------------------


def low_levels(nodes: list[str], alone: bool, levels: int) -> list[list[str]]:
    """The nodes of a partition, level by level up to its root.

    A partition that is ``alone`` stops at one node; others go up as far as all partitions do.
    """
    tree = [nodes]
    while len(tree[-1]) > 1 or (not alone and len(tree) <= levels):
        last = tree[-1]
        tree.append([_parent(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return tree


def _partition_roots(placed: DataFrame, levels: int) -> DataFrame:
    """(grp, block, blocks, root, path): each partition with the root of its own subtree."""

    def step(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        blocks = rows.column("blocks")[0].as_py()
        root = low_levels(rows.column("leaf").to_pylist(), blocks == 1, levels)[-1][0]
        return pa.table(
            {
                "grp": rows.column("grp").slice(0, 1),
                "block": rows.column("block").slice(0, 1),
                "blocks": rows.column("blocks").slice(0, 1),
                "root": [root],
            }
        )

    narrow = placed.select("grp", "block", "blocks", "at", "leaf")
    roots = narrow.groupBy("grp", "block").applyInArrow(
        step, "grp string, block long, blocks long, root string"
    )
    return roots.withColumn("path", F.array().cast(f"array<{_STEP}>"))


def _swap(state: DataFrame, width: int) -> DataFrame:
    """A round of the butterfly between subtrees of ``width`` partitions."""
    subtree = F.floor(F.col("block") / width).cast("long")
    meeting = F.floor(F.col("block") / (width * FANOUT)).cast("long")
    lane = F.pmod("block", F.lit(width))
    held = F.least(F.lit(width), F.col("blocks") - subtree * width)  # partitions of the subtree
    active = state.where(F.col("blocks") > width)
    offers = active.select(
        "grp",
        meeting.alias("meeting"),
        F.explode(F.sequence(lane, F.lit(width - 1).cast("long"), held)).alias("lane"),
        F.struct(F.pmod(subtree, F.lit(FANOUT)).cast("int").alias("place"), "root").alias("offer"),
    )
    met = offers.groupBy("grp", "meeting", "lane").agg(
        F.sort_array(F.collect_list("offer")).alias("offers")  # at most FANOUT
    )
    joined = state.withColumns({"meeting": meeting, "lane": lane}).join(
        met, ["grp", "meeting", "lane"], "left"
    )
    own = F.pmod(subtree, F.lit(FANOUT)).cast("int")
    others = F.transform(F.filter("offers", lambda o: o["place"] != own), lambda o: o["root"])
    step = F.struct(own.alias("place"), others.alias("siblings"))
    parent = F.sha2(F.array_join(F.transform("offers", lambda o: o["root"]), "").cast("binary"), 256)
    takes_part = F.col("blocks") > width
    return joined.select(
        "grp",
        "block",
        "blocks",
        F.when(takes_part, parent).otherwise(F.col("root")).alias("root"),
        F.when(takes_part, F.array_append("path", step)).otherwise(F.col("path")).alias("path"),
    )


def butterfly(placed: DataFrame, levels: int = LOW_LEVELS) -> DataFrame:
    """(grp, block, blocks, root, path): each partition with its group's root and upper proof."""
    state = stored(_partition_roots(placed, levels), "merkle-roots")
    most = state.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        state = stored(_swap(state, width), "merkle-round")
        width *= FANOUT
    return state


def with_blocks(placed: DataFrame, levels: int) -> DataFrame:
    size = FANOUT**levels
    return placed.withColumns(
        {
            "block": F.floor(F.col("at") / size).cast("long"),
            "blocks": F.ceil(F.col("total") / size).cast("long"),
        }
    )


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and its proof."""
    for place, siblings in path:
        node = _parent([*siblings[:place], node, *siblings[place:]])
    return node


def _prove(placed: DataFrame, upper: DataFrame, levels: int, keep_paths: bool) -> DataFrame:
    """Leaves with their proofs, made within the partitions.

    ``upper`` has for each partition its path from there up to ``root``, and what else the
    rows are to be given (``subroot``). ``folded`` is what the whole path makes of ``changed``,
    or else of the leaf.
    """
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    extra = [c for c in ("subroot", "root") if c in upper.columns]
    schema = (
        f"grp string, key {kinds['key']}, leaf string, "
        + "".join(f"{c} string, " for c in extra)
        + f"path array<{_STEP}>, proof_sha256 string, folded string"
    )
    path_type = pa.list_(
        pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])
    )

    def step(rows: pa.Table, tops: pa.Table) -> pa.Table:
        rows, top = rows.sort_by("at"), tops.slice(0, 1).to_pylist()[0]
        nodes = rows.column("leaf").to_pylist()
        upper_path = [(s["place"], s["siblings"]) for s in top["path"]]
        above = "".join("".join(siblings) for _, siblings in upper_path)
        tree = low_levels(nodes, top["blocks"] == 1, levels)
        paths, proofs, folded = [], [], []
        for i, (leaf, changed) in enumerate(zip(nodes, rows.column("changed").to_pylist())):
            path = []
            for level in tree[:-1]:
                start = i - i % FANOUT
                run = level[start : start + FANOUT]
                path.append((i - start, run[: i - start] + run[i - start + 1 :]))
                i //= FANOUT
            below = "".join("".join(siblings) for _, siblings in path)
            path += upper_path
            proofs.append(hashlib.sha256((below + above).encode("ascii")).hexdigest())
            folded.append(fold(changed or leaf, path))
            paths.append([{"place": p, "siblings": s} for p, s in path] if keep_paths else None)
        out = rows.select(["grp", "key", "leaf"])
        for name in extra:
            out = out.append_column(name, pa.array([top[name]] * len(nodes), pa.string()))
        out = out.append_column("path", pa.array(paths, path_type))
        out = out.append_column("proof_sha256", pa.array(proofs, pa.string()))
        return out.append_column("folded", pa.array(folded, pa.string()))

    return (
        placed.select("grp", "block", "key", "at", "leaf", "changed")
        .groupBy("grp", "block")
        .cogroup(upper.select("grp", "block", "blocks", "path", *extra).groupBy("grp", "block"))
        .applyInArrow(step, schema)
    )


def prove_leaves(leaves: DataFrame, levels: int = LOW_LEVELS, keep_paths: bool = False) -> DataFrame:
    """Roots and proofs for leaves ``grp, key, leaf, changed``.

    ``key`` orders the leaves of a group (null first), ``leaf`` is their hash and ``changed`` one
    to be tried in its place, or null. Gives ``grp, key, leaf, subroot, root, proof_sha256,
    folded_root, verified``, and ``path``, the place and siblings of each level from the leaf up
    to the root, if they are to be kept.
    """
    # A letter before the name keeps a null group apart, and ahead of the others.
    named = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("s"), "grp"), F.lit("")))
    placed = stored(
        with_blocks(with_places(stored(named, "merkle-leaves"), ["key", "leaf", "changed"]), levels),
        "merkle-places",
    )
    trees = butterfly(placed, levels)
    groups = trees.where("block = 0").select(
        F.lit("").alias("grp"),
        F.col("grp").alias("key"),
        F.col("root").alias("leaf"),
        F.lit(None).cast("string").alias("changed"),
    )
    tops = stored(with_blocks(with_places(groups, ["key"]), levels), "merkle-groups")
    above = _prove(tops, butterfly(tops, levels), levels, keep_paths=True).select(
        F.col("key").alias("grp"), F.col("root"), F.col("path").alias("higher")
    )
    upper = trees.withColumnRenamed("root", "subroot").join(above, "grp").select(
        "grp", "block", "blocks", "subroot", "root", F.concat("path", "higher").alias("path")
    )
    proved = _prove(placed, stored(upper, "merkle-upper"), levels, keep_paths)
    return proved.select(
        F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias("grp"),
        "key",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
        *(["path"] if keep_paths else []),
    )


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    keep_paths: bool = False,
) -> DataFrame:
    """A leaf per row over ``columns``, its proof, and whether it verifies.

    Rows for which ``where`` holds are checked with the values ``changed`` of some columns in
    place of their own, as a reader would check a copy of the data.
    """
    given = [F.col(f"`{c}`") for c in columns]
    leaf = sealed(*given)
    tried = F.lit(None).cast("string")
    if changed and where is not None:
        tried = F.when(where, sealed(*[changed.get(c, v) for c, v in zip(columns, given)]))
    leaves = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("grp"),
        F.col(f"`{id_col}`").alias("key"),
        leaf.alias("leaf"),
        tried.alias("changed"),
    )
    return prove_leaves(leaves, keep_paths=keep_paths).drop("grp").withColumnRenamed("key", id_col)
