import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riverlake.llm import merkle
from riverlake.llm.merkle import FANOUT, fold, manifest, prove_leaves
from riverlake.llm.queries import MERKLE_COLUMNS
from tests.llm.helpers import DOCS, lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    said = []
    for value in (row[0], row[3], row[2], row[4], text):
        value = None if value is None else str(value)
        said.append("-" if value is None else f"{len(value.encode())}:{value}")
    return h(*said)


def tree(nodes):
    """Levels, and per leaf its (place, siblings) on the way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i // FANOUT * FANOUT :][:FANOUT]
            path.append((i % FANOUT, run[: i % FANOUT] + run[i % FANOUT + 1 :]))
            i //= FANOUT
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        pairs = sorted((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), str(r), r) for r in groups[g])
        made[g] = ([p[-1] for p in pairs], *tree([p[2] for p in pairs]))
    root, higher = tree([made[g][1] for g in order])
    out = []
    for g, above in zip(order, higher):
        ordered, subroot, paths = made[g]
        for row, path in zip(ordered, paths):
            path, leaf = path + above, leaf_of(row, row[1])
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            tried = leaf_of(row, row[1] and lower(row[1])) if tampered else leaf
            folded = fold(tried, path)
            proof = h(*[s for _, siblings in path for s in siblings])
            out.append((row[0], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def given(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("leaf", "grp", "key", "at", "root")})


def proved(df, **more):
    out = manifest(
        df, MERKLE_COLUMNS, changed={"text": merkle.lower_ascii(F.col("text"))},
        where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **more,
    )
    assert out.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return out


def made_up(n):
    sources = [None, "", "b", "é", "hot"]
    return [
        (i * 7 % 1009, f"Text {i} É" if i % 3 else "low", "en", sources[4 if i % 3 == 0 else i % 4], i)
        for i in range(n)
    ]


@pytest.mark.parametrize("levels, n", [(3, 300), (1, 900), (2, 700)])
def test_equals_a_plain_tree(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle.prove_leaves, "__defaults__", (levels, False))
    rows = made_up(n) + made_up(5) + [(None, None, None, None, None), (None, "A", None, "hot", 1), (5, "B", "x", "lone", None)]
    assert sorted((tuple(r) for r in proved(given(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 33, 256, 257, 290])
def test_ragged_last_runs(spark, n):
    leaves = [("g", i, h(str(i)), None) for i in range(n)]
    df = spark.createDataFrame(leaves, "grp string, key long, leaf string, changed string")
    root, paths = tree([x[2] for x in leaves])
    found = {r.key: r for r in prove_leaves(df, levels=1, keep_paths=True).collect()}
    for i, path in enumerate(paths):
        assert [(s.place, s.siblings) for s in found[i].path] == path
        assert found[i].root == found[i].subroot == root and found[i].verified


def test_empty_table_one_row_and_long_text(spark):
    assert proved(given(spark, [])).collect() == []
    rows = [(1, "Ä" * 500_000, "en", "s", 1)]
    assert [tuple(r) for r in proved(given(spark, rows)).collect()] == brute(rows)


def test_a_change_anywhere_shows(spark):
    rows = made_up(60)
    roots = {proved(given(spark, rows)).first().root}
    for i, column in enumerate([0, 1, 2, 4]):
        changed = [list(r) for r in rows]
        changed[7 + i][column] = changed[7 + i][column] * 2 if changed[7 + i][column] else 9
        roots.add(proved(given(spark, [tuple(r) for r in changed])).first().root)
    assert len(roots) == 5
