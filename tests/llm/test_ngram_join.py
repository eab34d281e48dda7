import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riverlake.llm import ngram_join
from riverlake.llm.components import components
from riverlake.llm.ngram_join import jaccard_components, keep_one
from tests.llm.helpers import DOCS, brute_components, docs, sentence


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Groups of copies and near copies, shared passages, short and odd texts."""
    rng = random.Random(4)
    base, passage = sentence(1, 120), sentence(2, 60)
    texts = [base] * 12 + [edited(rng, base, rng.randrange(4)) for _ in range(60)]
    texts += [f"{passage} {sentence(10 + i, rng.choice([5, 8, 10, 12, 40]))}" for i in range(40)]
    texts += [None, "", "  \n", "one", "One", "a b c", "a  b\nc", "a b c d", "same " * 30, "same " * 50]
    texts += [sentence(99, 3000), edited(rng, sentence(99, 3000), 20)]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    assert result(jaccard_components(docs(spark, texts))) == brute_components(dict(enumerate(texts)))


@pytest.mark.parametrize("least", [2, 10**9])
def test_frequent_ngrams_and_ranges_change_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(ngram_join, "LEAST_HEAVY", least)
    monkeypatch.setattr(ngram_join, "BUCKET", 500)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    texts = corpus()
    assert result(jaccard_components(docs(spark, texts))) == brute_components(dict(enumerate(texts)))


def test_a_hub_links_texts_that_do_not_link_themselves(spark):
    hub = sentence(3, 104).split()
    texts = [" ".join(hub)] + [
        " ".join(hub[:i] + [f"other{i}"] + hub[i + 1 :]) for i in range(5, 100, 6)
    ]
    texts = [" ".join(w for w in t.split()) for t in texts]
    assert result(jaccard_components(docs(spark, texts))) == brute_components(dict(enumerate(texts)))


def test_repeated_and_missing_ids_and_other_columns(spark):
    a, b = sentence(5, 30), sentence(6, 30)
    rows = [(1, a), (1, a), (2, b), (2, a), (3, b), (None, a), (None, None)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    df = df.withColumns({c: F.lit("x") for c in ("id", "gram", "n", "component", "spread")})
    # Id 2 stands for its least text, which is that of id 1.
    assert result(jaccard_components(df)) == {1: (26, 1), 2: (26, 1), 3: (26, 3)}
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(0, ""), (0, a), (1, a), (3, b)]
    )


def test_empty_table(spark):
    assert jaccard_components(docs(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_frequent_ngrams_have_one_frequency_in_all_ranges(spark):
    """More of them in a range than the tasks' counts that were sent out add up to."""
    gram = next(iter(ngram_join.shingle_sets(*ngram_join.word_hashes(pa.array(["a b c d e"])), 5)))
    table = docs(spark, [f"a b c d e u{i} v{i}" for i in range(90)]).repartition(30)
    heavy, times = gram, np.array([8])
    postings = ngram_join._postings(table, "doc_id", "text", 5, 3, heavy, times)
    rows = ngram_join._shared(postings, 3, heavy, times).collect()
    wanted = gram.view(np.int64)[0]
    found = [f for r in rows for g, f in zip(r.grams, r.freqs) if g == wanted]
    assert len({r.bucket for r in rows}) == 3 and found == [8] * 90
