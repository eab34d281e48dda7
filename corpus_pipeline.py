"""A training corpus from raw documents: each stage works on what the one before it kept.

A null text counts as empty and fails the quality rules. Repeated rows are judged alike; the join
keeps one row of each group of similar documents, that of the least id (and of the least text, if
rows share an id). An empty table goes through all stages and stays empty. Texts of any length
are read whole. Extra columns are kept; only the last stage adds columns, which replace others
of their names. Each stage's output is written once, so a lost executor costs a reread.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.llm import byte_bpe, decontaminate, ngram_join, quality, toxicity
from riverlake.llm.queries import MULTI_RANKS
from riverlake.llm.rows import small_batches, spare, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of similar ones."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, their number, and whether decoding gives the text back.

    Columns of the input with the name of one of these, in any case of letters, are replaced.
    """
    added = {"token_ids", "n_tokens", "round_trip"}
    kept = [c for c in docs.columns if c.lower() not in added]
    decoded = spare(docs, "decoded")
    encoded = byte_bpe.encode_texts(
        docs, MULTI_RANKS, public_tokenizers.PATTERN, keep=kept, decoded_col=decoded
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select(
        *[F.col(f"`{c}`") for c in kept],
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col(decoded) == text).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("byte_bpe", encoding),
]

# No SQL: learned thresholds and scores, similarity joins and merges by rank are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
