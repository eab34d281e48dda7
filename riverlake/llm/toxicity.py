"""Toxicity scores: gradient-boosted trees over a few dense features, calibrated.

A lexicon of words and word beginnings is learned from labelled texts by log-odds. Features of
a text are how dense its words are in the lexicon, how often such words stand near a word of
the second person, capitals, punctuation, and words written to hide letters. Boosted trees
score them, and an isotonic regression on labelled rows that the trees have not seen turns the
scores into probabilities.

Only labelled rows outside the held-out fold whose document is there are used to learn. At most
``TRAIN_ROWS`` of each label are taken, by a hash of the id; that bounds the work of learning at
any size of the input, and weights restore the rates of the labels. The lexicon holds at most
``LEXICON_SIZE`` entries, those least likely to be there by chance.
Labels, ids and all other columns than the text are no features.

Defined results: a null text is empty and is scored like any text. Repeated rows give equal
rows. A row without an id is scored and is not held out. Of several labels of a document the
highest holds; of rows that share an id the least text is learned from. An empty table gives no
rows. A text of any length is read whole. Without labels the score is 0, and with labels of one value it is their rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from riverlake.llm.rows import over_texts, stored

TRAIN_ROWS = 12_000  # of each label
WITHIN_PLATEAU = 0.01  # weight of the trees' own share in a score
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
LEXICON_SIZE = 512
LEAST_TEXTS = 4  # toxic texts that a lexicon entry must be in
MARGIN = 1.5
LEAST_ODDS = 2.0  # logarithm of how much more often it is in toxic texts
PREFIXES = (4, 5, 6)
NEAR = 5  # words around one of the second person
SEED = 7

# Words of the second person, and characters that stand for letters.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "youre", "du", "dich", "dir", "dein", "deine", "ihr",
    "tu", "toi", "te", "ton", "ta", "vous", "votre", "usted", "tú", "ti", "vos",
}
STAND_INS = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile("[^ \t-\r]+")
_HIDING = re.compile(r"[^\W\d_][\d@$!*|._-]+[^\W\d_]|^[\d@$][^\W\d_]")
TEXT, FEATURES, SCORE = "__toxicity_text", "__toxicity_features", "__toxicity_score"


def plain(word: str) -> str:
    """A word in lower case, with stand-ins read as letters, other signs and doubles left out."""
    trimmed = word.lower().strip(".,;:!?\"'()[]{}<>#*%&$|-_")
    letters = filter(str.isalpha, trimmed.translate(STAND_INS))
    out: list[str] = []
    for letter in letters:
        if not out or out[-1] != letter:
            out.append(letter)
    return "".join(out)


def keys(word: str) -> list[str]:
    """The lexicon entries that a word can meet: itself, and its beginnings."""
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) >= k]] if word else []


def _lexicon_counts(train: DataFrame) -> DataFrame:
    """(key, toxic, times): in how many texts each key is, counted per task first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in counts], pa.string()),
                    pa.array([t for _, t in counts], pa.int32()),
                    pa.array(counts.values(), pa.int64()),
                ],
                ["key", "toxic", "times"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {key for word in set(_WORD.findall(text)) for key in keys(plain(word))}
                counts.update((key, int(toxic)) for key in found)
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    counted = over_texts(train, "toxic", "text", "key string, toxic int, times long", step)
    return counted.groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("times")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("times")).otherwise(0)).alias("c"),
    )


def learn_lexicon(train: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Keys that are too often in toxic texts to be so by chance, at most ``LEXICON_SIZE``.

    ``n`` texts have a key; if a text were toxic at the usual rate each time, the chance of as
    many toxic ones would be at most ``exp(-surprise)``. For the keys taken that is below
    ``exp(-MARGIN)`` in the number of keys, so hardly one is there by chance.
    """
    counts = stored(_lexicon_counts(train), "toxicity-keys")
    rate = toxic / (toxic + clean)
    n, share = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    surprise = n * (
        share * F.log(share / rate)
        + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    ranked = (
        counts.where(F.col("t") >= LEAST_TEXTS)
        .select("key", odds.alias("odds"), surprise.alias("surprise"))
        .where(F.col("surprise") >= math.log(max(2, counts.count())) + MARGIN)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("surprise"), "key")
        .limit(LEXICON_SIZE)
    )
    return {row.key: row.odds for row in ranked.collect()}


class Reader:
    """Features of texts, with what is known about each word cached."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.cache: dict[str, int] = {}

    def flags(self, word: str) -> int:
        read = plain(word)
        weight = max((self.lexicon.get(key, 0.0) for key in keys(read)), default=0.0)
        hides = bool(_HIDING.search(word))
        code = min(255, int(weight * 16)) << 8
        code |= (weight > 0) | (read in SECOND_PERSON) << 1 | hides << 4
        code |= (len(word) > 2 and word.isupper()) << 2 | ("!" in word or "?" in word) << 3
        if len(word) <= 64:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[word] = code
        return code

    def features(self, text: str) -> list[float]:
        known, compute = self.cache.get, self.flags
        codes = np.fromiter(
            (compute(w) if (code := known(w)) is None else code for w in _WORD.findall(text)),
            np.int32,
        )
        words = max(1, len(codes))
        hits = np.flatnonzero(codes & 1)
        second = np.flatnonzero(codes & 2)
        near = 0
        if len(hits) and len(second):
            right = np.searchsorted(second, hits)
            ahead = second[np.minimum(right, len(second) - 1)] - hits
            behind = hits - second[np.maximum(right - 1, 0)]
            near = int(((np.abs(ahead) <= NEAR) | (np.abs(behind) <= NEAR)).sum())
        weight = float((codes[hits] >> 8).sum()) / 16
        return [
            float(min(len(hits), 50)),
            len(hits) / words,
            weight / words,
            float((codes[hits] >> 8).max()) / 16 if len(hits) else 0.0,
            min(weight, 500.0),
            near / words,
            float(min(near, 50)),
            float(((codes & 4) > 0).sum()) / words,
            float(((codes & 8) > 0).sum()) / words,
            float(((codes & 16) > 0).sum()) / words,
            float(((codes & 17) == 17).sum()) / words,
        ]


def with_features(docs: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with the features of each text in ``FEATURES``."""
    given = docs.select("*", F.col(text_col).cast("string").alias(TEXT))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                rows = pa.array([reader.features(t or "") for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], rows], [*part.schema.names[:-1], FEATURES]
                )

    schema = StructType([*docs.schema.fields, StructField(FEATURES, ArrayType(DoubleType()))])
    return given.mapInArrow(step, schema)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def with_score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """The rows of ``docs`` with a score in [0, 1] in the column ``SCORE``."""
    marks = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .dropna()
        .groupBy("id")
        .agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
        .withColumn("fold", fold_of("id", FOLDS))
        .where(F.col("fold") != HELD_OUT)
    )
    present = stored(marks.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi"), "toxicity-marks")
    # Both labels get the same room, so that rare ones are learned from at any size.
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))
    chosen = present.withColumn("rank", rank).where(F.col("rank") <= TRAIN_ROWS).drop("rank")
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # The marks sent out are bounded: twice TRAIN_ROWS rows of three numbers.
    picked = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "fold")
    train = stored(picked.agg(F.min("text").alias("text")), "toxicity-train")
    known_labels = {row.toxic: row["count"] for row in present.groupBy("toxic").count().collect()}
    seen = {row.toxic: row["count"] for row in train.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return docs.withColumn(SCORE, F.lit(float(next(iter(seen), 0))))
    lexicon = learn_lexicon(train, seen[1], seen[0])
    # What the bound left out of a label is made up for by weight.
    weight = F.when(F.col("toxic") == 1, known_labels[1] / seen[1]).otherwise(known_labels[0] / seen[0])
    known = stored(with_features(train, "text", lexicon).drop("text"), "toxicity-features").select(
        array_to_vector(FEATURES).alias("vector"),
        F.col("toxic").cast("double").alias("label"),
        weight.alias("weight"),
        "fold",
    )
    fitting = known.where(F.col("fold") != CALIBRATION)
    checking = known.where(F.col("fold") == CALIBRATION)
    if fitting.select("label").distinct().count() < 2 or checking.isEmpty():
        fitting = checking = known
    booster = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=12, maxDepth=3,
        stepSize=0.3, seed=SEED, minInstancesPerNode=8,
    )
    trees = booster.fit(fitting)
    trees.setPredictionCol("__toxicity_label").setProbabilityCol("__toxicity_shares")
    trees.setRawPredictionCol("__toxicity_margins")
    raw = vector_to_array("__toxicity_shares")[1]
    calibration = IsotonicRegression(
        featuresCol="__toxicity_raw", labelCol="label", predictionCol=SCORE, weightCol="weight"
    ).fit(trees.transform(checking).select("label", "weight", raw.alias("__toxicity_raw")))
    trees.setFeaturesCol("__toxicity_vector")
    rows = with_features(docs, text_col, lexicon).withColumn(
        "__toxicity_vector", array_to_vector(FEATURES)
    )
    scored = calibration.transform(trees.transform(rows).withColumn("__toxicity_raw", raw))
    # On the plateaus of the calibration the trees' own shares still tell texts apart.
    nudge = (F.col("__toxicity_raw") - F.col(SCORE)) * WITHIN_PLATEAU
    score = F.least(F.greatest(F.col(SCORE) + nudge, F.lit(0.0)), F.lit(1.0))
    return scored.select(*[scored[f"`{c}`"] for c in docs.columns], score.alias(SCORE))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Per row: id, whether it is held out, its score, and the predicted label."""
    narrow = docs.select(id_col, text_col)
    held_out = F.coalesce(fold_of(id_col, FOLDS) == HELD_OUT, F.lit(False))
    return with_score(narrow, labels, id_col, text_col, label_col).select(
        id_col,
        held_out.alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that score below one half."""
    return with_score(docs, labels, **columns).where(F.col(SCORE) < 0.5).drop(SCORE)
