"""The dealt operators as queries over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    hmm,
    license_scan,
    merkle,
    ngram_join,
    phrases,
    quality,
    secret_scan,
    token_count,
    toxicity,
    url_filter,
)
from riverlake.llm.oracles import oracles
from riverlake.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles are similar."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the best passage for each pair."""
    return decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, and one that says control strings."""
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_turns(given.union(added)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    encoded = byte_bpe.encode_texts(
        table(spark, sf_dir, "documents"),
        MULTI_RANKS,
        public_tokenizers.PATTERN,
        keep=["doc_id"],
        decoded_col="decoded",
    )
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cutoffs certified on the labels."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.drop("trust", "distrust")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the base and the hidden Markov model."""
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), path)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document."""
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


MERKLE_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; a fifth is checked with its text in lower case."""
    return merkle.manifest(
        table(spark, sf_dir, "documents"),
        MERKLE_COLUMNS,
        changed={"text": merkle.lower_ascii(F.col("text"))},
        where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )


_QUERIES: list[Query] = [
    op1_ngram_join,
    op2_decontamination,
    op3_chat_format,
    op4_license_scan,
    op5_byte_bpe,
    op6_quality_rules,
    op7_url_filter,
    op8_language_model,
    op9_toxicity,
    op10_token_counts,
    op11_phrase_collocations,
    op12_secret_scan,
    op13_merkle_manifest,
]

ORACLES = oracles(URL_RULES, MERKLE_COLUMNS)


def llm_queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}
