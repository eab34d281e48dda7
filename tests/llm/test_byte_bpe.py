import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from riverlake.llm import byte_bpe
from riverlake.llm.byte_bpe import Encoder, decode_tokens, encode_piece, encode_texts, load_ranks, merge_leaf
from tests.llm.helpers import docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = ["a", "b", "the", "é", "é", " ", "  ", "\n", "\x1c", "\x85", " ", "'s", "1", "中", "🙂", "!!", "\x00"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={}
    )


@pytest.mark.parametrize("leaf, block", [(48, 1 << 18), (2, 5)])
def test_ids_equal_the_library(monkeypatch, library, leaf, block):
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", block)
    encoder, rng = Encoder(PATH, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choices(SIGNS, k=rng.randrange(25)))
        assert list(encoder.encode(text)) == library.encode_ordinary(text)
    for text in ["a" * 5000, "ab" * 999, "-=" * 700, "thend" * 800 + " " * 900]:
        assert list(encoder.encode(text)) == library.encode_ordinary(text)


def test_tree_equals_direct_merging():
    ranks, rng = load_ranks(PATH), random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choices(b"abthen ", k=rng.randrange(1, 300)))
        assert encode_piece(ranks, piece) == merge_leaf(ranks, piece)


def test_round_trip_of_a_table(spark, library):
    texts = ["Hello there", None, "", "x" * 200_000, "é 中\n\n", "Hello there"]
    table = docs(spark, texts, token_ids=F.lit("clash"), text_to_encode=F.lit(1))
    encoded = encode_texts(table, PATH, public_tokenizers.PATTERN)
    both = encode_texts(table, PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    rows = {r.doc_id: r for r in decode_tokens(encoded, PATH).collect()}
    assert {r.doc_id: (r.token_ids, r.decoded) for r in both.collect()} == {
        i: (r.token_ids, r.decoded) for i, r in rows.items()
    }
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i].token_ids == library.encode_ordinary(text or "")
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_clashing_names_and_null_ids(spark):
    table = docs(spark, ["a b"], TOKEN_IDS=F.lit(1), Decoded=F.lit(2), given_value=F.lit(3))
    both = encode_texts(table, PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    assert both.columns == [*table.columns[:5], "given_value", "token_ids", "decoded"]
    assert bytes(both.first().decoded) == b"a b" and both.first().given_value == 3
    none = table.select(F.lit(None).cast("array<int>").alias("token_ids"))
    assert decode_tokens(none, PATH).first().decoded is None


def test_cache_is_emptied_by_bytes(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"thing{i} of" for i in range(300))
    assert list(encoder.encode(text)) == library.encode_ordinary(text)
    assert len(encoder.cache) < 10


def test_a_frequent_piece_stays_in_the_cache(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    made, encode = [], byte_bpe.encode_piece
    monkeypatch.setattr(byte_bpe, "encode_piece", lambda ranks, p: made.append(p) or encode(ranks, p))
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"zqoften qzx{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(600))
    assert list(encoder.encode(text)) == library.encode_ordinary(text)
    assert made.count(b" zqoften") == 1 and len(made) > 500


def test_empty_table(spark):
    encoded = encode_texts(docs(spark, []), PATH, public_tokenizers.PATTERN)
    assert decode_tokens(encoded, PATH).collect() == []
