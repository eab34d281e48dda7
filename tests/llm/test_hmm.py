import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlake.llm import hmm
from riverlake.llm.hmm import CLASSES, STATES, Model, expected_counts, forward, score_texts
from tests.llm.helpers import docs, lower, sentence, words


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def model(seed=0):
    rng = np.random.default_rng(seed)
    return Model(rng.random((2, STATES)), rng.random((STATES, STATES)), rng.random((STATES, CLASSES)))


def texts_of_classes(sizes, seed=1):
    values = np.random.default_rng(seed).integers(0, 50, sum(sizes)).astype(np.int32)
    return values, np.append(0, np.cumsum(sizes))


def test_forward_is_the_sum_over_all_paths():
    own = model()
    values, bounds = texts_of_classes([3, 1, 4, 200])
    got = forward(values, bounds, own)
    for k in range(3):
        text = values[bounds[k] : bounds[k + 1]]
        total = 0.0
        for path in np.ndindex(*[STATES] * len(text)):
            p = own.begins[0][path[0]] * own.emits[text[0], path[0]]
            for a, b, c in zip(path, path[1:], text[1:]):
                p *= own.moves[a, b] * own.emits[c, b]
            total += p
        assert got[k] == pytest.approx(math.log10(total))
    assert np.isfinite(got).all()


def test_counts_equal_plain_forward_and_backward():
    own = model(3)
    values, bounds = texts_of_classes([5, 128, 130, 1, 300])
    begins, moves, emits = expected_counts(values, bounds, own)
    plain = [np.zeros_like(x) for x in (begins, moves, emits)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        for start in range(a, b, hmm.STRETCH):
            text = values[start : min(b, start + hmm.STRETCH)]
            first = own.begins[0 if start == a else 1]
            alpha = [first * own.emits[text[0]]]
            for c in text[1:]:
                alpha.append((alpha[-1] @ own.moves) * own.emits[c])
                alpha[-1] /= alpha[-1].sum()
            beta = [np.ones(STATES)]
            for c in text[:0:-1]:
                beta.append(own.moves @ (own.emits[c] * beta[-1]))
                beta[-1] /= beta[-1].sum()
            beta.reverse()
            gamma = np.array(alpha) * np.array(beta)
            gamma /= gamma.sum(axis=1, keepdims=True)
            plain[0][0 if start == a else 1] += gamma[0]
            for t in range(len(text) - 1):
                xi = alpha[t][:, None] * own.moves * (own.emits[text[t + 1]] * beta[t + 1])[None, :]
                plain[1] += xi / xi.sum()
            for c, g in zip(text, gamma):
                plain[2][:, c] += g
    for got, want in zip((begins, moves, emits), plain):
        assert np.allclose(got, want)


def test_training_raises_the_likelihood():
    values, bounds = texts_of_classes([100] * 30)
    own, before = model(5), -np.inf
    for _ in range(5):
        now = forward(values, bounds, own).sum()
        assert now > before - 1e-6
        before, own = now, Model(*expected_counts(values, bounds, own))


@pytest.mark.parametrize("common", [hmm.COMMON, 3])
def test_counts_and_base_scores_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(hmm, "COMMON", common)
    monkeypatch.setattr(hmm, "PAIRS", 40)
    texts = [sentence(i % 5, 30) for i in range(40)] + [None, "", "A a A", "long " * 60_000]
    table = docs(spark, texts, key=F.lit("x"), logs=F.lit(1)).withColumn(
        "doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))
    )
    table = table.union(table.where("doc_id = 4"))
    rows = score_texts(table).collect()
    by_id = {(i if i != 3 else None): words(lower(t or "")) + [None] for i, t in enumerate(texts)}
    count = Counter(by_id[4])
    for i, tokens in by_id.items():
        if i is None or not held(i):
            count.update(tokens)
    if held(4):
        count = count - Counter(by_id[4])
    n, v = sum(count.values()), len(count)
    assert sorted(str(r.doc_id) for r in rows) == sorted([*map(str, by_id), "4"])
    for r in rows:
        tokens = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id is not None and held(r.doc_id), len(tokens), n)
        assert r.n_known == sum(count[w] > 0 for w in tokens)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score) and r.score < 0


def test_no_training_texts(spark):
    ids = [i for i in range(200) if held(i)][:3]
    table = docs(spark, [None] * 200).where(F.col("doc_id").isin(ids))
    assert {(r.train_tokens, r.score) for r in score_texts(table).collect()} == {(0, 0.0)}
    assert score_texts(docs(spark, [])).collect() == []


def test_long_texts_alone_are_learned_from(spark):
    texts = [sentence(i % 3, hmm.START_TOKENS + 100) for i in range(5)]
    rows = score_texts(docs(spark, texts)).collect()
    assert any(not r.held_out for r in rows)
    assert all(math.isfinite(r.score) and abs(r.score - r.base_score) > 1 for r in rows)


def test_start_takes_distinct_texts_and_cuts_long_ones(spark, monkeypatch):
    monkeypatch.setattr(hmm, "START_TEXTS", 6)
    monkeypatch.setattr(hmm, "START_TOKENS", 3 * hmm.STRETCH)
    n = 10 * hmm.STRETCH + 5
    rows = [(i % 2, 1, 3, [7, 7, 0]) for i in range(50)] + [(None, 1, 3, [7, 7, 0])]
    rows += [(i, i, 2, [i, 0]) for i in range(2, 5)] + [(5, 5, n, list(range(n)))]
    sequences = spark.createDataFrame(rows, "id long, key long, n long, classes array<int>")
    got = {r["key"]: r["classes"] for r in hmm.start_sample(sequences).to_pylist()}
    spread = [x for i in (0, 3, 7) for x in range(i * hmm.STRETCH, (i + 1) * hmm.STRETCH)]
    assert got == {1: [7, 7, 0], 2: [2, 0], 3: [3, 0], 4: [4, 0], 5: spread}
