import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverlake.llm import byte_bpe
from riverlake.llm.token_count import TokenCounter, count_tokens
from tests.llm.helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "B", "é", "é", " ", "\n", "\x1c", "\x85", " ", "İ", "Σ", "ς", "<|endoftext|>", "<|", "'S", "1", "½", "中", "🙂", "..", "ẞ", "가"]


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_counts_equal_the_library(monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", block)
    library, counter, rng = Tokenizer.from_file(PATH), TokenCounter(PATH), random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(25))) for _ in range(2000)]
    texts += ["a" * 5000, "thend" * 900, "1" * 50, "." * 999]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text) == len(found.ids), text


def test_table(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["Hello there", None, "", "word " * 2049, "word " * 2048, "Hello there"]
    rows = {r.doc_id: r for r in count_tokens(docs(spark, texts, n_tokens=F.lit("x")), PATH).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(rows[i])[1:] == (len((text or "").encode()), n, n > 2048)
    assert count_tokens(docs(spark, []), PATH).collect() == []
