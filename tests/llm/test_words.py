import random

import numpy as np
import pyarrow as pa
import pytest

from riverlake.llm import words as module
from riverlake.llm.words import shingle_sets, word_hashes
from tests.llm.helpers import lower, shingle_set, words


@pytest.mark.parametrize("block", [3, 17, 1 << 21])
def test_words_are_the_same_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    rng, seen = random.Random(5), {}
    signs = ["a", "B", "é", " ", "\n", "\x1c", "中", "\x0b ", "ab"]
    for _ in range(200):
        texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 30]))) for _ in range(4)]
        hashes, bounds = word_hashes(pa.array(texts, pa.string()))
        expected = [words(lower(t)) for t in texts]
        assert np.diff(bounds).tolist() == [len(w) for w in expected]
        for word, value in zip(sum(expected, []), hashes.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_have_the_sizes_of_plain_sets():
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e a b", "x " * 9, "A b\tC"]
    sets = list(shingle_sets(*word_hashes(pa.array(texts)), 5))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]


def test_long_words_differ():
    hashes, _ = word_hashes(pa.array(["x" * 9000, "x" * 9001, "y" + "x" * 8999]))
    assert len(set(hashes.tolist())) == 3
