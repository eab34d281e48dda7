import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverlake.llm import phrases
from riverlake.llm.phrases import Bitmap, DoubleArrayTrie, collocations
from tests.llm.helpers import DOCS, lower

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, most=3, first=2000, percent=50):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(zip(*[w[i:] for i in range(k)]))
    out = {}
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= percent * a:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out[lang, rank] = (p.decode(), -a, left, right, sizes[lang], -score)
    return out


def mined(df, **more):
    rows = collocations(df, **more).collect()
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}


def table(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)


def test_equals_brute_force_with_ties_nulls_and_copies(spark):
    rng = np.random.default_rng(5)
    words = ["Red", "red", "blue", "x", "y", "z", "é", "un", "a b", "q'r"]
    rows = []
    for i in range(240):
        said = [words[k] for k in rng.zipf(1.5, 30) % len(words)]
        signs = rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "  "], 30)
        rows.append(("".join(w + s for w, s in zip(said, signs)), ["en", None, "und", ""][i % 4]))
    rows += rows[:40] + [(None, "en"), ("", None), ("..!?", "de"), ("word " * 9, "de")]
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("phrase", "h", "rank", "n")})
    assert mined(df) == brute(rows)
    assert mined(df, first=3, most_words=4, inside_percent=80) == brute(rows, most=4, first=3, percent=80)


def test_blocks_of_candidates_and_shared_bits_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"w{k}" for k in rng.integers(0, 12, 40)), "en") for _ in range(120)]
    want = brute(rows)
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 40)
    monkeypatch.setattr(phrases, "HOLD_PHRASES", 50)
    monkeypatch.setattr(phrases, "HOLD_BYTES", 500)
    assert mined(table(spark, rows).repartition(5)) == want


def test_a_hot_language_and_a_long_text(spark):
    rows = [("one two three " * 30_000, "en")] + [("one two, four five", "en")] * 50 + [("four five", "fr")] * 9
    assert mined(table(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], DOCS)) == {}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3), st.integers(1, 30), st.integers(0, 2**32))
def test_trie_counts_what_is_there(k, size, seed):
    rng = np.random.default_rng(seed)
    alphabet = rng.integers(1, 2**63, max(2, size // 3), dtype=np.uint64)
    listed = np.unique(rng.choice(alphabet, (size, k)), axis=0)
    listed = listed[rng.permutation(len(listed))]
    trie = DoubleArrayTrie([listed[:, i] for i in range(k)])
    text = rng.choice(np.append(alphabet, [np.uint64(0), np.uint64(7)]), 200)
    found = np.bincount(trie.count(text), minlength=len(listed))
    for row, n in zip(listed, found):
        assert n == sum((text[i : i + k] == row).all() for i in range(200 - k + 1))


def test_trie_with_large_families():
    alphabet = np.arange(1, 3001, dtype=np.uint64) * np.uint64(7919)
    first = np.repeat(alphabet[:40], 500)
    second = np.concatenate([np.random.default_rng(i).choice(alphabet, 500, False) for i in range(40)])
    trie = DoubleArrayTrie([first, second])
    at = trie.count(np.stack([first, second], 1).ravel())
    assert set(range(len(first))) <= set(at.tolist())


@pytest.mark.parametrize("bits", [1 << 26, 1 << 16])
def test_bitmap_holds_what_it_was_given(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "BITS", bits)
    values = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    held = Bitmap(spark.createDataFrame([(int(v),) for v in values], "h long"), "h")
    assert held.holds(values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 10_000).astype(np.uint64)
    assert held.holds(others).mean() < 0.02


def test_listed_phrases_grow_with_candidates_not_with_tasks(spark, monkeypatch):
    """Rows that tasks send: each of 64 meets every phrase, which most need not list."""
    sent = []

    def spy(seqs, k, shared, earlier, real=phrases.unlisted):
        rows = real(seqs, k, shared, earlier)
        sent.append(rows.count())
        return rows

    monkeypatch.setattr(phrases, "unlisted", spy)
    words = np.random.default_rng(8).integers(1, 2**63, 101)
    rows = [([*words.tolist(), 0, i + 1], i % phrases.SHARES) for i in range(640)]
    seqs = spark.createDataFrame(rows, "seq array<long>, share int").repartition(64)
    tables = phrases.list_candidates(seqs, 2, None, 10)
    found = [tuple(r) for t in tables for r in t.collect()]
    assert sorted(found) == sorted(zip(words[:-1].tolist(), words[1:].tolist()))
    assert sum(sent) <= 10 * 100  # the ten rows of the first round


@pytest.mark.parametrize("known", [0, 7, 1 << 21])
def test_rounds_and_what_is_known_of_them_change_nothing(spark, monkeypatch, known):
    rng = np.random.default_rng(9)
    rows = [(" ".join(f"w{k}" for k in rng.integers(0, 9, 30)), ["en", "fr"][i % 2]) for i in range(200)]
    monkeypatch.setattr(phrases, "BATCH_ROWS", 3)
    monkeypatch.setattr(phrases, "HOLD_PHRASES", 40)
    monkeypatch.setattr(phrases, "KNOWN", known)
    monkeypatch.setattr(phrases, "ROUNDS", (16, 32, 64))
    assert mined(table(spark, rows).repartition(5)) == brute(rows)


def test_ties_at_the_last_rank_go_by_phrase(spark):
    rows = [(f"b{i} a{i}. a{i} b{i}", "en") for i in range(12)] * 10
    for first in (1, 5, 23):
        assert mined(table(spark, rows), first=first) == brute(rows, first=first)


@pytest.mark.parametrize("spread", [1, 40, 0xFFFF, 3 * 0xFFFF])
def test_packed_counters_are_small_and_add_up(spark, spread):
    rng = np.random.default_rng(10)
    places = np.append(np.cumsum(rng.integers(1, 2 * spread, 4000)) - 1, (1 << 32) - 1)
    numbers = rng.zipf(1.3, len(places)).clip(1, 2**40)
    batch = phrases._packed(places, numbers, 24)
    size = sum(len(x.as_py()) for c in batch.columns[2:] for x in c)
    assert size <= (3.5 if spread < 0xFFFF else 6) * len(places) + 14 * (numbers >= 256).sum()

    def add(counters, at, some):
        counters[at] += some

    def done(part, counters):
        at = np.flatnonzero(counters)
        columns = [pa.array(at + (part << 24)), pa.array(counters[at])]
        return pa.RecordBatch.from_arrays(columns, ["place", "n"])

    packed = spark.createDataFrame(pa.Table.from_batches([batch, batch]))
    rows = phrases._folded(packed, "place long, n long", 1 << 24, np.int64, add, done).collect()
    assert {r.place: r.n for r in rows} == dict(zip(places.tolist(), (2 * numbers).tolist()))
