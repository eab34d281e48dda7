"""Exact Jaccard join of documents on word n-grams, by prefix filtering.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches a
threshold. All n-grams have one order, rare ones first. Similar sets share an n-gram among
the first few of each (the prefix), so only documents that meet there are compared, if their
sizes (length filter), the places of the shared n-gram (positional filter) and the spread of
the rest over ranges of hashes (suffix filter) allow for it, and each pair once.

How it runs:

1. One pass gives each document the size and a 128-bit key of its set. Equal sets form a class
   of which the least id goes on. The pass also finds n-grams that are so frequent (at least a
   ``HEAVY``-th of all) that at most ``HEAVY`` of them exist; these are sent to the executors.
2. The n-grams are packed by ranges of their hash and counted there, frequent ones apart and
   spread by document, so that no range holds a hot one. Those of one document alone go no
   further: they come first in every order and match nothing.
3. The shared ones return to their document, which ranks them and keeps its prefix.
4. Within the documents that share a prefix n-gram, all are first compared with two pivots.
   That merges groups of copies at a cost in proportion to their size, and pairs inside a
   component need no comparison. Then all remaining pairs that the filters let through are
   compared, so that no link between components is lost.

Defined results: one row per distinct id; a null text is empty; a document without words has
no n-grams and links with nothing; one with fewer words than ``n`` has their sequence as its
only n-gram. Rows that repeat an id count as one document, that of the least text. Rows
without an id are left out. Other columns are not read. N-grams are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlake.llm.components import components
from riverlake.llm.rows import over_texts, spare, stored
from riverlake.llm.words import mix, shingle_sets, word_hashes

HEAVY = 1 << 16  # n-grams that make up more than this share of all are handled apart
BUCKET = 1_000_000  # n-grams of a range, which one task counts in memory
FLUSH = 1 << 19  # n-grams that a task packs at a time
BINS = 16  # ranges of hashes for the suffix filter
STAR_ROUNDS = 2
LEAST_HEAVY = 64

_SIGNED = "id long, spread long, n long, k1 long, k2 long, gram long, times long"
_SIGNED_NAMES = ["id", "spread", "n", "k1", "k2", "gram", "times"]
_PACKED = "bucket int, ids array<long>, counts array<int>, grams array<long>"
_SHARED = _PACKED + ", freqs array<int>"
_SKETCH = (
    "id long, n long, prefix array<long>, places array<long>, shared array<long>, bins array<int>"
)


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return list(shingle_sets(*word_hashes(batch.column(1)), n))


def _spread(ids: pa.Array) -> pa.Array:
    """32 mixed bits of each id."""
    mixed = mix(ids.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(32)
    return pa.array(mixed.astype(np.int64))


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A row per document with its set's size and key, and rows of locally frequent n-grams."""

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times >= max(8, int(times.sum()) // HEAVY)
        none = pa.nulls(int(often.sum()), pa.int64())
        columns = [none] * 5
        columns += [pa.array(grams[often].view(np.int64)), pa.array(times[often].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, _SIGNED_NAMES)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            sets = _sets(batch, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = [np.array([s.sum() for s in sets], np.uint64).view(np.int64)]
            keys.append(np.array([mix(s).sum() for s in sets], np.uint64).view(np.int64))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _spread(batch.column(0)), pa.array(sizes), *map(pa.array, keys)]
                + [none, none],
                _SIGNED_NAMES,
            )
            held += [s for s in sets if len(s)]
            if sum(map(len, held)) >= FLUSH:
                yield frequent(held)
                held = []
        if held:
            yield frequent(held)

    return over_texts(docs, id_col, text_col, _SIGNED, step)


def _lists(values: np.ndarray, owner: np.ndarray, owners: np.ndarray, kind) -> pa.Array:
    """A list per owner of its run of values; both are sorted by owner."""
    offsets = np.append(np.searchsorted(owner, owners), len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _pack(bucket, run, ids, grams, freqs=None) -> pa.RecordBatch:
    """Rows by bucket: n-grams by document, with each document's id once."""
    order = np.lexsort((run, bucket))
    bucket, run, grams = bucket[order], run[order], grams[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(fresh)
    owners = np.unique(bucket)
    counts = np.diff(np.append(heads, len(run))).astype(np.int32)
    columns = [
        pa.array(owners.astype(np.int32)),
        _lists(ids[run[heads]], bucket[heads], owners, pa.int64()),
        _lists(counts, bucket[heads], owners, pa.int32()),
        _lists(grams.view(np.int64), bucket, owners, pa.int64()),
    ]
    names = ["bucket", "ids", "counts", "grams"]
    if freqs is not None:
        columns.append(_lists(freqs[order].astype(np.int32), bucket, owners, pa.int32()))
        names.append("freqs")
    return pa.RecordBatch.from_arrays(columns, names)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _unpack(table: pa.Table):
    ids, counts = _flat(table, "ids"), _flat(table, "counts")
    return ids, np.repeat(np.arange(len(ids)), counts), _flat(table, "grams").view(np.uint64)


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _id_range(ids: np.ndarray, parts: int) -> np.ndarray:
    return _range_of(mix(ids.view(np.uint64)), parts)


def _frequency(grams: np.ndarray, heavy: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Times of the frequent n-grams, 0 for all others."""
    if not len(heavy):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
    return np.where(heavy[at] == grams, times[at], 0)


def _postings(docs: DataFrame, id_col, text_col, n, parts, heavy, times) -> DataFrame:
    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sets = [s for _, s in held]
        grams = np.concatenate(sets)
        ids = np.array([i for i, _ in held], np.int64)
        run = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hot = _frequency(grams, heavy, times) > 0
        bucket = np.where(hot, _id_range(ids, parts)[run], _range_of(grams, parts))
        return _pack(bucket, run, ids, grams)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, grams in zip(batch.column(0).to_pylist(), _sets(batch, n)):
                if len(grams):
                    held.append((doc, grams))
                    size += len(grams)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return over_texts(docs, id_col, text_col, _PACKED, step)


def _shared(postings: DataFrame, parts: int, heavy: np.ndarray, times: np.ndarray) -> DataFrame:
    """N-grams of more than one document, with their frequency, by ranges of documents."""

    def count(table: pa.Table) -> pa.Table:
        ids, run, grams = _unpack(table)
        order = np.argsort(grams, kind="stable")
        grams, run = grams[order], run[order]
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        counts = np.diff(np.append(heads, len(grams)))
        freqs = np.repeat(counts, counts)
        # Of a frequent one the number sent out alone: a range's own would give each range an order.
        sent = _frequency(grams, heavy, times)
        freqs = np.minimum(np.where(sent > 0, sent, freqs), 2**31 - 1)
        many = freqs > 1
        run, bucket = run[many], _id_range(ids, parts)[run[many]]
        packed = _pack(bucket, run, ids, grams[many], freqs[many])
        return pa.Table.from_batches([packed])

    return postings.groupBy("bucket").applyInArrow(count, _SHARED)


def _sketches(shared: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Per class with an n-gram to meet others on: its prefix, and all its shared n-grams."""

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        by_id = right.sort_by("rep")
        reps, sizes = by_id["rep"].to_numpy(), by_id["n"].to_numpy()
        ids, run, grams = _unpack(left)
        freqs = _flat(left, "freqs")
        empty = pa.Table.from_batches([], schema=_sketch_schema())
        if not len(reps) or not len(ids):
            return empty
        at = np.minimum(np.searchsorted(reps, ids), len(reps) - 1)
        keep = (reps[at] == ids)[run]
        doc, grams, freqs = at[run[keep]], grams[keep], freqs[keep]
        if not len(doc):
            return empty
        order = np.lexsort((grams, doc))  # to drop the n-grams of repeated rows
        doc, grams, freqs = doc[order], grams[order], freqs[order]
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1]))
        doc, grams, freqs = doc[fresh], grams[fresh], freqs[fresh]
        bins = (grams >> np.uint64(60)).astype(np.int64)
        docs, count = np.unique(doc, return_counts=True)
        spread = np.bincount(np.searchsorted(docs, doc) * BINS + bins, minlength=len(docs) * BINS)
        order = np.lexsort((grams, freqs, doc))
        heads = np.cumsum(count) - count
        place = np.arange(len(doc)) - np.repeat(heads - (sizes[docs] - count), count)
        length = sizes[docs] - (sizes[docs] * num + den - 1) // den + 1
        early = place < np.repeat(length, count)
        meets = np.add.reduceat(early.astype(np.int64), heads) > 0
        listed = _lists(grams[order][early].view(np.int64), doc[early], docs, pa.int64())
        table = pa.table(
            [
                pa.array(reps[docs]),
                pa.array(sizes[docs]),
                listed,
                _lists(place[early], doc[early], docs, pa.int64()),
                _lists(grams.view(np.int64), doc, docs, pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(spread) + 1, BINS, dtype=np.int32)),
                    pa.array(spread.astype(np.int32)),
                ),
            ],
            schema=_sketch_schema(),
        )
        return table.filter(pa.array(meets))

    return (
        shared.groupBy("bucket").cogroup(classes.groupBy("bucket")).applyInArrow(rank, _SKETCH)
    )


def _sketch_schema() -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema(
        [
            ("id", pa.int64()),
            ("n", pa.int64()),
            ("prefix", many),
            ("places", many),
            ("shared", many),
            ("bins", pa.list_(pa.int32())),
        ]
    )


def _may_link(num: int, den: int):
    """Length and positional filter of two entries (id, n, place) and (id2, n2, place2)."""
    fits = (F.least("n", "n2") * den) >= (F.greatest("n", "n2") * num)
    at_most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return fits & (at_most * (num + den) >= (F.col("n") + F.col("n2")) * num)


def _pairs(meeting: DataFrame) -> DataFrame:
    return meeting.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those that reach the threshold, after the suffix filter."""

    def side(name: str, *columns: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    enough = lambda overlap: overlap * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    at_most = F.aggregate(
        F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x
    )
    likely = (
        pairs.join(side("a", "n", "bins"), "a")
        .join(side("b", "n", "bins"), "b")
        .where(enough(at_most))
        .select("a", "b", "n_a", "n_b")
    )
    both = likely.join(side("a", "shared"), "a").join(side("b", "shared"), "b")
    return both.where(enough(F.size(F.array_intersect("shared_a", "shared_b")))).select("a", "b")


def spark_empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _with_component(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    num: int = 75,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per id: size of its set of ``n``-grams, and the least id reachable by links.

    Two documents link when ``den * |A & B| >= num * |A | B|``.
    """
    with_id = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    signed = stored(_signatures(with_id, id_col, text_col, n), "ngram-sets")
    sets = signed.where("gram is null").select("id", "spread", "n", "k1", "k2").distinct()
    if not sets.groupBy("id").count().where("count > 1").isEmpty():
        with_id = with_id.groupBy(id_col).agg(
            F.min(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(text_col)
        )
        signed = stored(_signatures(with_id, id_col, text_col, n), "ngram-sets")
    frequent = signed.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    chosen = signed.where("gram is null").select("id", "spread", "n", "k1", "k2").distinct()
    total = signed.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // BUCKET))
    # At most HEAVY n-grams can be that frequent, so the table sent out has a bound.
    hot = frequent.where(F.col("times") >= max(LEAST_HEAVY, -(-total // HEAVY))).toArrow()
    heavy = hot["gram"].to_numpy().view(np.uint64)
    order = np.argsort(heavy)
    heavy, times = heavy[order], hot["times"].to_numpy()[order]

    classes = stored(
        chosen.where("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "spread")).alias("r")),
        "ngram-classes",
    ).select(F.col("r.id").alias("rep"), F.col("r.spread").alias("spread"), "n", "k1", "k2")
    in_range = F.expr(f"cast(spread * {parts}L div 4294967296L as int)").alias("bucket")

    postings = _postings(with_id, id_col, text_col, n, parts, heavy, times)
    sketches = stored(
        _sketches(
            _shared(postings, parts, heavy, times),
            classes.select(in_range, "rep", "n"),
            num,
            den,
        ),
        "ngram-sketches",
    )
    entries = sketches.select(
        "id", "n", F.explode(F.arrays_zip("prefix", "places")).alias("e")
    ).select("id", "n", F.col("e.prefix").alias("gram"), F.col("e.places").alias("place"))
    likely = _may_link(num, den)

    labels = spark_empty(docs, "id long, component long")
    links = spark_empty(docs, "a long, b long")
    seen = links
    for _ in range(STAR_ROUNDS):
        placed = _with_component(entries, labels)
        first = lambda *order: F.min(F.struct(*order, "id", "n", "place", "component"))
        pivots = (
            placed.groupBy("gram")
            .agg(
                first(F.col("place").alias("o")).alias("p"),
                first(F.xxhash64("id", "gram").alias("o")).alias("q"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
            )
            .where("low <> high")
            .select("gram", F.explode(F.array("p", "q")).alias("p"))
            .selectExpr("gram", "p.id id2", "p.n n2", "p.place place2", "p.component component2")
        )
        meeting = placed.join(pivots, "gram").where("component <> component2").where(likely)
        fresh = stored(_pairs(meeting).join(seen, ["a", "b"], "left_anti"), "ngram-pairs")
        found = stored(_verified(fresh, sketches, num, den), "ngram-links")
        seen, links = seen.union(fresh), links.union(found)
        labels = components(links)

    placed = _with_component(entries, labels)
    open_grams = (
        placed.groupBy("gram")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("gram")
    )
    still = stored(placed.join(open_grams, "gram", "left_semi"), "ngram-open")
    other = still.select(
        "gram",
        F.col("id").alias("id2"),
        F.col("n").alias("n2"),
        F.col("place").alias("place2"),
        F.col("component").alias("component2"),
    )
    meeting = still.join(other, "gram").where("id < id2 and component <> component2").where(likely)
    fresh = _pairs(meeting).join(seen, ["a", "b"], "left_anti")
    found = stored(_verified(fresh, sketches, num, den), "ngram-links")
    labels = components(links.union(found))

    members = chosen.join(
        classes.select("rep", "n", "k1", "k2"), ["n", "k1", "k2"], "left"
    ).select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join: int) -> DataFrame:
    """The rows of ``docs`` with the least id of each component; of rows with that id, one.

    Rows without an id are all kept.
    """
    linked = jaccard_components(docs, id_col=id_col, text_col=text_col, **join)
    least = linked.where(F.col(id_col) == F.col("component_id")).select(id_col)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    place = spare(docs, "rank_of_row")
    one = docs.join(least, id_col, "left_semi").withColumn(place, rank).where(F.col(place) == 1)
    return one.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
