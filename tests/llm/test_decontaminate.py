import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riverlake.llm import decontaminate
from riverlake.llm.decontaminate import (
    RADIUS,
    BlockIndex,
    Items,
    best_passage,
    drop_leaks,
    find_leaks,
    fingerprints,
    running_bits,
    shingles,
    similarity,
)
from riverlake.llm.words import word_hashes
from tests.llm.helpers import docs, sentence


def test_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**63, 200, dtype=np.uint64)
    asked = own[rng.integers(0, 200, 2000)].copy()
    for _ in range(RADIUS + 2):
        asked ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    found = set(zip(*(x.tolist() for x in BlockIndex(own).near(asked))))
    near = np.bitwise_count(asked[:, None] ^ own[None, :]) <= RADIUS
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_fingerprints_are_majorities():
    words = np.random.default_rng(2).integers(0, 2**63, 40, dtype=np.uint64)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    for size in (1, 6, 13):
        got = fingerprints(running_bits(words), size)
        for i in range(len(words) - size + 1):
            assert (np.packbits(bits[i : i + size].sum(0) * 2 > size) == got[i : i + 1].view(np.uint8)).all()


def test_edited_items_are_found_as_by_brute_force():
    rng = random.Random(3)
    items = [sentence(k, n) for k, n in enumerate([5, 7, 12, 13, 20, 33, 58, 90, 300])]
    index = Items(list(range(len(items))), items)
    for item, text in enumerate(items):
        own = Counter(shingles(word_hashes(pa.array([text]))[0]).tolist())
        for _ in range(15):
            w = text.split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"new{rng.randrange(99)}"] * rng.randrange(2)
            before = [f"pre{i}" for i in range(rng.randrange(20))]
            words, bounds = word_hashes(pa.array([" ".join([*before, *w, "post", "post"])]))
            best = max(
                similarity(own, Counter(shingles(words[a:b]).tolist()))
                for a in range(max(0, len(before) - 3), min(len(words), len(before) + 9))
                for b in range(max(a + 1, len(words) - 12), len(words) + 1)
            )
            found = index.search(words, bounds).get((0, item))
            if best >= 0.75:
                assert found is not None and found[0] >= best - 1e-12


@pytest.mark.parametrize("seed", range(60))
def test_best_passage_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    alphabet = rng.integers(1, 2**63, rng.integers(1, 25), dtype=np.uint64)
    item_words = rng.choice(alphabet, rng.integers(5, 30))
    text = np.concatenate([rng.choice(alphabet, rng.integers(0, 30)), item_words, rng.choice(alphabet, rng.integers(0, 30))])
    text = np.delete(text, rng.integers(0, len(text), rng.integers(0, 3)))
    item = Counter(shingles(item_words).tolist())
    around = shingles(text).tolist() if len(text) >= 5 else []
    best = (0.0, 0, 0)
    for i in range(len(around)):
        for j in range(i + 1, len(around) + 1):
            best = max(best, (similarity(item, Counter(around[i:j])), -i, j - i + 4))
    found = best_passage(item, text, 0)
    assert found[0] == pytest.approx(best[0] if best[0] >= 0.75 else 0.0)
    if found[0]:
        passage = Counter(shingles(text[-found[1] :][: found[2]]).tolist())
        assert similarity(item, passage) == pytest.approx(found[0])


def test_long_items_take_seconds(spark):
    long = sentence(5, 20_000)
    edited = " ".join(w if i % 60 else "edit" for i, w in enumerate(long.split()))
    again = "again " * 6000
    began = time.perf_counter()
    bench = spark.createDataFrame([(1, long), (2, again)], "item_id long, text string")
    rows = find_leaks(docs(spark, [f"x y z {edited} u v", again[:30_000], sentence(6, 20_000)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 1), (1, 2)]
    assert time.perf_counter() - began < 90


def test_blocks_by_words_change_nothing(spark, monkeypatch):
    items = [sentence(k, 30) for k in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = docs(spark, [*items[:3], sentence(50, 40), None, ""])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert sorted(r.doc_id for r in drop_leaks(table, bench).collect()) == [3, 4, 5]
    assert {(r.doc_id, r.item_id) for r in find_leaks(table, bench).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_leaks_and_clean_rows(spark):
    item, other = sentence(1, 30), sentence(2, 25)
    texts = [f"x y {item.upper()} z", sentence(9, 40), None, "", other, " ".join([other] * 300), item[:60]]
    table = docs(spark, texts + [texts[0]], item_id=F.lit(5), similarity=F.lit("x"))
    table = table.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    bench = spark.createDataFrame(
        [(1, item), (2, other), (3, other), (4, ""), (5, None), (None, item), (1, item)],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(0))
    hits = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in find_leaks(table, bench).collect()}
    assert hits == {
        (0, 1): (1.0, 2, 30), (7, 1): (1.0, 2, 30), (None, 2): (1.0, 0, 25), (None, 3): (1.0, 0, 25),
        (5, 2): (1.0, 0, 25), (5, 3): (1.0, 0, 25),
    }
    clean = drop_leaks(table, bench)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 6]


def test_short_items_match_their_sequence(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    table = docs(spark, ["x alpha beta y", "beta alpha", "alpha", "Alpha\nBETA"])
    assert sorted(r.doc_id for r in find_leaks(table, bench).collect()) == [0, 3]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs(spark, ["a b c"]), bench).collect() == []
    assert drop_leaks(docs(spark, ["a b c"]), bench).count() == 1
    assert find_leaks(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_items_with_as_many_spread_edits_as_allowed_are_found():
    sizes = [40, 80, 100, 120, 200, 300, 400]
    texts = [sentence(k, n) for k, n in enumerate(sizes)]
    index = Items(list(range(len(texts))), texts)
    missed = []
    for item, (n, text) in enumerate(zip(sizes, texts)):
        own = Counter(shingles(word_hashes(pa.array([text]))[0]).tolist())
        for kind in ("replace", "delete", "insert"):
            for shift in range(-4, 5):
                w, edits = text.split(), {"replace": (n - 4) // 35, "delete": (n - 4) // 32, "insert": (n - 4) // 31}[kind]
                for k in range(edits, 0, -1):
                    at = k * n // (edits + 1) + shift
                    w[at : at + (kind != "insert")] = [] if kind == "delete" else [f"new{k}"]
                words, bounds = word_hashes(pa.array([" ".join(w)]))
                assert similarity(own, Counter(shingles(words).tolist())) >= 0.75
                if (0, item) not in index.search(words, bounds):
                    missed.append((n, kind, shift))
    assert not missed
