import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riverlake.llm.quality import GRIDS, binomial_tail, certified_cutoffs, base_features, judge, keep_good
from tests.llm.helpers import docs, sentence, words

LABELS = "doc_id long, quality int"


def counts(text):
    text, w = text or "", words(text)
    windows, covered, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    signs = ["a", "b", "c", "a b c", "#", "é中", "\n", "\n", " ", "\x0b", "\x1c", "x|y", "\r\n"]
    texts = [" ".join(rng.choices(signs, k=rng.randrange(80))) for _ in range(150)]
    texts += [None, "", "\n \n", sentence(1, 49), sentence(1, 50), "same " * 5000, sentence(2, 20_000), texts[0]]
    table = docs(spark, texts, words=F.lit(1), kept=F.lit("x"))
    rows = {r.doc_id: tuple(r)[1:7] for r in judge(table, spark.createDataFrame([], LABELS)).collect()}
    assert rows == {i: counts(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 100), (3, 500), (40, 9000), (0, 2000), (9, 900), (50, 1000), (0, 0), (3000, 400_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for p in (0.01, 0.3):
        for r in df.select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            if r.n == 0 or r.k >= r.n * p:
                assert r.t == 1.0
                continue
            logs = [
                math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1)
                + j * math.log(p) + (r.n - j) * math.log(1 - p)
                for j in range(r.k + 1)
            ]
            assert r.t == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-6, abs=1e-300)


def labelled(n):
    """Good texts, and bad ones of which every word ends in a symbol."""
    texts = [
        " ".join(f"{w}{'#' if i % 5 == 0 else ''}" for w in sentence(i, 60).split()) for i in range(n)
    ]
    return texts, [(i, int(i % 5 > 0)) for i in range(n)]


def test_rules_are_on_only_with_enough_labels(spark):
    for n, on in ((200, False), (2500, True)):
        texts, labels = labelled(n)
        table, marks = docs(spark, texts), spark.createDataFrame(labels, LABELS)
        chosen = certified_cutoffs(base_features(table), marks).collect()
        assert any(r.rule == "symbol_share" for r in chosen) == on
        rows = judge(table, marks).collect()
        assert all(r.kept for r in rows if r.doc_id % 5)
        assert not any(r.kept for r in rows if r.doc_id % 5 == 0) == on


def test_copies_of_a_good_text_count_once(spark):
    texts, labels = labelled(400)
    texts += [sentence(1, 60)] * 3000
    labels += [(i, 1) for i in range(400, 3400)]
    marks = spark.createDataFrame(labels, LABELS)
    assert certified_cutoffs(base_features(docs(spark, texts)), marks).collect() == []


def test_kept_rows(spark):
    texts, labels = labelled(2500)
    labels += [(None, 0), (1, None), (5, 1), (10, 0)]
    table = docs(spark, [*texts, None, texts[1], texts[5]], kept=F.lit(1), stratum=F.lit(2))
    table = table.withColumns(
        {
            "doc_id": F.when(F.col("doc_id") < 2501, F.col("doc_id")),
            "lang": F.when(F.col("doc_id") % 2500 != 1, F.col("lang")),
        }
    )
    kept = keep_good(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    # The row without an id and with a good text stays, that with a bad one goes.
    assert ids == [-1] + [i for i in range(2500) if i % 5]
    assert set(GRIDS) >= {"symbol_share"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert judge(docs(spark, []), none).collect() == [] == keep_good(docs(spark, []), none).collect()
