"""Hidden Markov language model over word classes, trained by Baum-Welch in Spark.

Tokens are lower-cased words and an end per text. The most frequent ``OWN`` words have a class
each; all others share ``HASHED`` classes by their hash, inside which a word has its smoothed
share of the class (one part of which is left for words never seen). Hidden states emit
classes, so the model has a bounded number of parameters, while the counts it rests on cover
every word of the training texts. Expected counts of transitions and emissions are summed per
task, then across tasks, in each of ``ROUNDS`` passes over all training texts. They are taken
in stretches of ``STRETCH`` tokens; the first of a text and all others have a start
distribution each. A text's score is the exact likelihood of its whole sequence, by the scaled
forward recursion.

The starting point is fit on at most ``START_TEXTS`` distinct texts of any length, dealt by
hash; of one with more than ``START_TOKENS`` tokens, so many in stretches spread evenly over it.
Counts of the ``COMMON`` most frequent words go to the executors; those of other words meet
the texts they are in by ranges of hashes, packed by text.

Defined results: a null text is empty and has the end as its only token. Repeated rows give
equal rows; a row without an id is learned from and not held out. Without training texts the
score is that of the base. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlake.llm.rows import over_texts, stored
from riverlake.llm.words import mix, word_hashes

STATES = 8
OWN = 4096
HASHED = 1024
COMMON = 1 << 16
COMMON_SHARE = 1 << 22  # a common word is at least one token in so many, so no more can be
ROUNDS = 3
STRETCH = 128
GROUP = 1 << 19  # tokens that a task handles at a time
START_TEXTS, START_TOKENS, START_ROUNDS = 400, 5000, 20
PAIRS = 2_000_000  # pairs of a text and a word that one task looks up at a time
FLUSH = 1 << 20
EMISSION_PRIOR = 0.01

END = np.uint64(0x9E3779B97F4A7C15)
CLASSES = OWN + HASHED


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text begins."""
    words, bounds = word_hashes(texts)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def _place(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _text_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    weights = np.arange(len(hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    within = weights - np.repeat(weights[bounds[:-1]] - np.uint64(1), np.diff(bounds))
    return mix(np.add.reduceat(hashes * within, bounds[:-1])).view(np.int64)


def _word_counts(training: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, times) over the training texts, counted per task first."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        words, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"]
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(tokens(batch.column(1))[0])
            if sum(map(len, held)) >= 4 * FLUSH:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    rows = over_texts(training, id_col, text_col, "word long, times long", step)
    return rows.groupBy("word").agg(F.sum("times").alias("times"))


class Vocabulary:
    """The most frequent words with their counts, and totals."""

    def __init__(self, common: pa.Table, total: int, distinct: int, shared: pa.Table):
        words = common["word"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        self.words, self.times = words[order], common["times"].to_numpy()[order]
        rank = np.arange(len(words))[order]
        self.class_of = np.where(rank < OWN, rank, -1)
        self.total, self.distinct = total, distinct
        self.shared = np.ones(HASHED)  # of each hashed class: its tokens, its words, and one
        for hashed, tokens_in, words_in in zip(*(shared[c].to_pylist() for c in shared.column_names)):
            self.shared[hashed] += tokens_in + words_in

    def classes(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.class_of[at], -1) if len(self.words) else at
        hashed = OWN + (hashes >> np.uint64(32)).astype(np.int64) % HASHED
        return np.where(own >= 0, own, hashed).astype(np.int32)


def _sequences(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """Per row: classes, and what the common words add to the sums of logarithms."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, bounds = tokens(batch.column(1))
            at = _place(vocabulary.words, hashes)
            classes = vocabulary.classes(hashes, at)
            times = np.where(at >= 0, vocabulary.times[at], 0) if len(vocabulary.words) else at * 0
            logs = np.log10(times + 1.0)
            hashed = classes >= OWN
            shares = np.where(hashed, logs - np.log10(vocabulary.shared[classes * hashed - OWN * hashed]), 0.0)
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (logs, shares, (at >= 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_text_keys(hashes, bounds)),
                    pa.array(np.diff(bounds)),
                    *map(pa.array, sums),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(classes)),
                ],
                ["id", "key", "n", "logs", "shares", "known", "classes"],
            )

    return over_texts(
        docs,
        id_col,
        text_col,
        "id long, key long, n long, logs double, shares double, known long, classes array<int>",
        step,
    )


def _rare_sums(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary, counts: DataFrame, parts: int
) -> DataFrame:
    """(id, key, rare_logs, rare_known): sums over a text's words that are not common.

    Words and texts meet by ranges of words, and what each gives to a text by ranges of
    texts, packed both times, so that rows do not grow with the number of ranges. Each of a text's rows adds to them, so they are divided by the number of equal rows later.
    """
    part_of = lambda words: (words >> np.uint64(32)).astype(np.int64) % parts
    schema = "bucket int, ids array<long>, keys array<long>, sizes array<int>, words array<long>, times array<int>"

    def pack(held: list[tuple]) -> pa.RecordBatch:
        run, words = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        ids, keys = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        order = np.lexsort((words, run, part_of(words)))
        run, words = run[order], words[order]
        fresh = np.append(True, (run[1:] != run[:-1]) | (words[1:] != words[:-1]))
        heads = np.flatnonzero(fresh)
        times = np.diff(np.append(heads, len(run))).astype(np.int32)
        run, words = run[heads], words[heads]
        bucket = part_of(words)
        first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(first, len(run))).astype(np.int32)
        owners = np.unique(bucket)
        runs_at = np.append(np.searchsorted(bucket[first], owners), len(first)).astype(np.int32)
        words_at = np.append(np.searchsorted(bucket, owners), len(bucket)).astype(np.int32)
        lists = [(runs_at, ids[run[first]]), (runs_at, keys[run[first]]), (runs_at, sizes)]
        lists += [(words_at, words.view(np.int64)), (words_at, times)]
        return pa.RecordBatch.from_arrays(
            [pa.array(owners.astype(np.int32))]
            + [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for at, v in lists],
            ["bucket", "ids", "keys", "sizes", "words", "times"],
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, bounds = tokens(batch.column(1))
            rare = _place(vocabulary.words, hashes) < 0
            run = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[rare] + texts
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            held.append((run, hashes[rare], ids, _text_keys(hashes, bounds)))
            size, texts = size + len(run), texts + batch.num_rows
            if size >= FLUSH:
                yield pack(held)
                held, size, texts = [], 0, 0
        if size:
            yield pack(held)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = {c: left[c].combine_chunks().flatten().to_numpy() for c in left.column_names[1:]}
        known = right.sort_by("word")
        table, times = known["word"].to_numpy(), known["times"].to_numpy()
        at = _place(table, flat["words"])
        count = np.where(at >= 0, times[at], 0) if len(table) else np.zeros(len(at))
        logs, seen = flat["times"] * np.log10(count + 1.0), flat["times"] * (count > 0)
        at_text = np.cumsum(flat["sizes"]) - flat["sizes"]
        logs = np.add.reduceat(logs, at_text) if len(at_text) else logs
        seen = np.add.reduceat(seen, at_text) if len(at_text) else seen
        home = (mix(flat["ids"].view(np.uint64) ^ flat["keys"].view(np.uint64)) >> np.uint64(32)).astype(
            np.int64
        ) % parts
        order = np.argsort(home, kind="stable")
        owners = np.unique(home)
        bounds = pa.array(np.append(np.searchsorted(home[order], owners), len(home)).astype(np.int32))
        lists = (flat["ids"], flat["keys"], logs.astype(float), seen.astype(np.int64))
        return pa.table(
            [pa.array(owners.astype(np.int32))]
            + [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in lists],
            ["bucket", "ids", "keys", "logs", "known"],
        )

    def sum_up(table: pa.Table) -> pa.Table:
        flat = [table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "keys", "logs", "known")]
        order = np.lexsort(flat[1::-1])
        ids, keys, logs, known = (x[order] for x in flat)
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
        return pa.table(
            [ids[heads], keys[heads], np.add.reduceat(logs, heads), np.add.reduceat(known, heads)],
            ["id", "key", "rare_logs", "rare_known"],
        )

    packed = over_texts(docs, id_col, text_col, schema, step)
    by_part = counts.select(
        F.expr(f"cast(shiftrightunsigned(word, 32) % {parts}L as int)").alias("bucket"), "word", "times"
    )
    return (
        packed.groupBy("bucket")
        .cogroup(by_part.groupBy("bucket"))
        .applyInArrow(
            look_up,
            "bucket int, ids array<long>, keys array<long>, logs array<double>, known array<long>",
        )
        .groupBy("bucket")
        .applyInArrow(sum_up, "id long, key long, rare_logs double, rare_known long")
    )


class Model:
    """Start of texts, start of later stretches, transitions and emissions."""

    def __init__(self, begins: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        smooth = lambda x, prior: (x + prior) / (x + prior).sum(axis=-1, keepdims=True)
        self.begins, self.moves = smooth(begins, 0.01), smooth(moves, 0.01)
        self.emits = smooth(emits, EMISSION_PRIOR).T.copy()  # by class


def _stretches(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where stretches of at most STRETCH tokens begin, how long they are, whether they are first."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // STRETCH)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(bounds[:-1], pieces) + number * STRETCH
    return begin, np.minimum(STRETCH, np.repeat(bounds[1:], pieces) - begin), number == 0


def expected_counts(values: np.ndarray, bounds: np.ndarray, model: Model) -> list[np.ndarray]:
    """Baum-Welch counts of starts, transitions and emissions over texts of classes."""
    begins, moves = np.zeros((2, STATES)), np.zeros((STATES, STATES))
    emits = np.zeros((STATES, CLASSES))
    begin, size, first = _stretches(values, bounds)
    order = np.argsort(-size, kind="stable")
    begin, size, first = begin[order], size[order], first[order]
    step = max(1, GROUP // STRETCH)
    for at in range(0, len(begin), step):
        heads, sizes = begin[at : at + step], size[at : at + step]
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        alphas, scales = [], []
        for t in range(longest):
            n = active[t]
            emitted = model.emits[values[heads[:n] + t]]
            if t == 0:
                alpha = model.begins[np.where(first[at : at + step], 0, 1)] * emitted
            else:
                alpha = (alphas[-1][:n] @ model.moves) * emitted
            scale = alpha.sum(axis=1, keepdims=True)
            alphas.append(alpha / scale)
            scales.append(scale)
        beta = np.ones((len(heads), STATES))
        gammas: list[np.ndarray] = [np.zeros(0)] * longest
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if t < longest - 1:
                m = active[t + 1]
                ahead = beta[:m] * model.emits[values[heads[:m] + t + 1]] / scales[t + 1]
                moves += (alphas[t][:m].T @ ahead) * model.moves
                beta[:m] = ahead @ model.moves.T
            gammas[t] = alphas[t] * beta[:n]
        kind = np.where(first[at : at + step], 0, 1)
        for k in (0, 1):
            begins[k] += gammas[0][kind == k].sum(axis=0)
        seen = np.concatenate([values[heads[: active[t]] + t] for t in range(longest)])
        gamma = np.concatenate(gammas)
        for k in range(STATES):
            emits[k] += np.bincount(seen, weights=gamma[:, k], minlength=CLASSES)
    return [begins, moves, emits]


def _flat_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.num_columns - 1)
    sizes = np.array(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(), np.append(0, np.cumsum(sizes))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into groups of rows with about GROUP tokens, or one row."""
    for batch in batches:
        ends = np.cumsum(pa.compute.list_value_length(batch.column(batch.num_columns - 1)).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + 4 * GROUP)))
            yield batch.slice(start, stop - start)
            start = stop


def _start(sample: pa.Table) -> Model:
    rng = np.random.default_rng(11)
    texts = [np.array(x, np.int64) for x in sample["classes"].to_pylist()]
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    values = np.concatenate(texts)
    emits = np.zeros((STATES, CLASSES))
    for text in texts:
        np.add.at(emits[rng.integers(STATES)], text, 1.0)
    emits += np.bincount(values, minlength=CLASSES) * 0.1
    model = Model(np.ones((2, STATES)), np.eye(STATES) * 20 + 1, emits)
    for _ in range(START_ROUNDS):
        model = Model(*expected_counts(values, bounds, model))
    return model


def start_sample(sequences: DataFrame) -> pa.Table:
    """(key, classes) of the distinct texts that the start is fit on, long ones cut."""
    texts = sequences.groupBy(F.col("key").alias("start_key")).agg(F.min("id").alias("start_id"))
    sample = texts.orderBy(F.xxhash64("start_key"), "start_key").limit(START_TEXTS)
    most = START_TOKENS // STRETCH
    # The first stretch and later whole ones, so they are stretches again when put together.
    cut = F.expr(
        f"case when n <= {START_TOKENS} then classes else flatten(transform(sequence(0L, {most - 1}L),"
        f" i -> slice(classes, cast((i * ((n + {STRETCH - 1}) div {STRETCH})) div {most} as int)"
        f" * {STRETCH} + 1, {STRETCH}))) end"
    )
    chosen = sequences.join(
        F.broadcast(sample), (F.col("key") == F.col("start_key")) & F.col("id").eqNullSafe(F.col("start_id"))
    )
    cuts = chosen.select("key", cut.alias("classes"))
    return cuts.dropDuplicates(["key"]).toArrow().sort_by("key")


def train(sequences: DataFrame) -> Model | None:
    """The model after passes over all sequences; None if there are none."""
    first = start_sample(sequences)
    if not first.num_rows:
        return None
    model = _start(first)
    size = 2 * STATES + STATES * STATES
    for _ in range(ROUNDS):
        now = model

        def step(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
            for batch in _grouped(batches):
                for total, part in zip(sums, expected_counts(*_flat_lists(batch), now)):
                    total += part
            flat = np.concatenate([x.ravel() for x in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "value"])

        counted = sequences.select("classes").mapInArrow(step, "at long, value double")
        # One row per parameter of the model.
        table = counted.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(size + STATES * CLASSES)
        flat[table["at"].to_numpy()] = table["value"].to_numpy()
        model = Model(
            flat[: 2 * STATES].reshape(2, STATES),
            flat[2 * STATES : size].reshape(STATES, STATES),
            flat[size:].reshape(STATES, CLASSES),
        )
    return model


def forward(values: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the likelihood of each text's classes, by the scaled forward recursion."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = bounds[:-1][order], sizes[order]
    logs = np.zeros(len(sizes))
    alpha = np.tile(model.begins[0], (len(sizes), 1))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for t in range(longest):
        n = active[t]
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.moves
        alpha = alpha * model.emits[values[heads[:n] + t]]
        scale = alpha.sum(axis=1)
        logs[:n] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.zeros(len(sizes))
    out[order] = logs
    return out


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2
) -> DataFrame:
    """Per row: id, held_out, tokens, tokens known from training, base score and model score."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    is_held = F.coalesce(fold == held, F.lit(False))
    counts = stored(_word_counts(docs.where(~is_held), id_col, text_col), "lm-counts")
    sums = counts.agg(F.sum("times").alias("n"), F.count("*").alias("v")).first()
    often = counts.where(F.col("times") * COMMON_SHARE >= (sums.n or 0))
    common = often.orderBy(F.desc("times"), "word").limit(COMMON)
    top = common.toArrow()
    own = top.slice(0, OWN)["word"].to_pylist()
    # The words with a class of their own are taken out by a table of OWN rows.
    rest = counts.join(
        F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in own], "word long")),
        "word",
        "left_anti",
    )
    hashed = F.expr(f"cast(shiftrightunsigned(word, 32) % {HASHED} as int)").alias("hashed")
    shared = rest.groupBy(hashed).agg(F.sum("times").alias("t"), F.count("*").alias("w")).toArrow()
    vocabulary = Vocabulary(top, sums.n or 0, sums.v, shared)

    sequences = stored(_sequences(docs, id_col, text_col, vocabulary), "lm-sequences")
    id_fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    id_held = F.coalesce(id_fold == held, F.lit(False))
    model = train(sequences.where(~id_held))

    rare = sequences.agg((F.sum("n") - F.sum("known")).alias("rare")).first().rare or 0
    parts = max(1, -(-rare // PAIRS))
    sums_of_rare = _rare_sums(docs, id_col, text_col, vocabulary, counts, parts)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            values, bounds = _flat_lists(batch)
            logs = forward(values, bounds, model) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(logs)], [*batch.schema.names[:-1], "hidden"]
            )

    plain = sequences.select(
        F.coalesce("id", F.lit(-(2**63))).alias("id"),
        "key",
        "n",
        "logs",
        "shares",
        "known",
        F.col("id").isNotNull().alias("has_id"),
        "classes",
    )
    scored = plain.mapInArrow(
        step,
        "id long, key long, n long, logs double, shares double, known long, has_id boolean,"
        " hidden double",
    )
    scored = stored(scored, "lm-hidden")
    equal = scored.groupBy("id", "key").agg(F.count("*").alias("rows"))
    each = sums_of_rare.join(equal, ["id", "key"]).select(
        "id",
        "key",
        (F.col("rare_logs") / F.col("rows")).alias("rare_logs"),
        F.expr("rare_known div rows").alias("rare_known"),
    )
    total, distinct = vocabulary.total, vocabulary.distinct
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n") * float(np.log10(total + distinct + 1))
    return (
        scored.join(each, ["id", "key"], "left")
        .withColumn("id", F.when(F.col("has_id"), F.col("id")))
        .select(
            F.col("id").alias(id_col),
            id_held.alias("held_out"),
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("hidden") + F.col("shares") + rare_logs if model else base).alias("score"),
        )
    )
