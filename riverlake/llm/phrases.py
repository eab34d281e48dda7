"""Collocations: phrases that occur more often than their parts let expect, per language.

Counting goes up level by level. Words are counted first. A phrase of ``k`` words is a candidate
if both of its parts of ``k - 1`` words are frequent (its own count cannot exceed theirs), the
bucket of its hash holds enough phrases, each task's share cut off at ``LEAST``. All these tests
only let through too many, never too few. Candidates are listed from the texts in ``ROUNDS``, first
from few texts, then from many, where only those not yet listed are; so what is listed grows with
the candidates, not with the tasks that meet them. The candidates are cut into blocks of about
``TRIE_PHRASES``, and each block becomes a double-array trie that is sent to all tasks: one array
says where the children of a state begin, a second which state a slot belongs to. A task steps
the states of all places of its texts together, one level at a time, in numpy, counts the
accepting states with ``bincount``, and the counts of all tasks are added up.

What is sent out has a bound: a trie of a block, or a bitmap of ``BITS`` bits of frequent phrases
(which may hold others that share a bit), one of ``2 ** SAFE_BITS`` bits of safe buckets, and the
hashes of at most ``KNOWN`` listed phrases. Words are 64-bit hashes of word and language. Texts are
hashed twice, once for the words and once, with the rare words left out, into a stored table that
all later passes read. A level takes two passes,
and one more per block. Scores are found level by level: a phrase takes the counts of its parts
from its first and its last ``k - 1`` words. The words themselves are looked up for the first phrases
of each language and those that tie with the last of them.

Defined results: a null text is empty and a null language is ``und``, together with texts of
that language. Repeated rows count each time. Ties of score and count go by phrase, in byte
order. An empty table gives no rows. A text of any length is read whole, batch by batch. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlake.llm.rows import BATCH_ROWS, discard, small_batches, stored
from riverlake.llm.words import STEP, located_words, mix, text_bytes

LEAST = 10  # occurrences of a candidate
MOST_WORDS = 3
INSIDE_PERCENT = 50  # of a phrase's occurrences within a longer candidate: it is dropped
FIRST = 2000  # phrases of a language that are returned
SCALE = 1_000_000

TRIE_PHRASES = 2_000_000
BITS = 1 << 26
BUCKET_BITS, PART_BITS, SAFE_BITS = 32, 8, 26  # of phrase hashes: buckets, their parts, safe bits
COUNT_BITS = 16  # phrases whose counts are added up in one part
HOLD_BUCKETS = 1 << 21  # buckets that are held at a time
CHUNK = 4096  # bases that are tried together
HOLD_BYTES = 2 << 20  # of texts whose words are counted at a time
HOLD_PHRASES = 1 << 18  # of places whose phrases are listed at a time
SHARES, ROUNDS = 64, (1, 4, 16, 64)  # of the texts: where the rounds of listing end
KNOWN = 1 << 21  # hashes of listed phrases that tasks are sent, or hold of their own

_APART = np.zeros(256, bool)
_APART[[*b" \t.,;:!?\n\x0b\x0c\r"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True


# -- texts as sequences of hashed words -----------------------------------------------------


def _language_code(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8"))


class Words:
    """The words of a batch of texts: where they are, their hashes, and where pieces begin."""

    def __init__(self, langs: list[str], texts: pa.Array):
        self.langs = langs
        self.data, offsets = text_bytes(texts)
        self.starts, hashes = located_words(self.data, offsets, _APART)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        codes = np.array([_language_code(lang) for lang in langs], np.uint64)
        self.hashes = mix(hashes + codes[self.text]) if len(hashes) else hashes
        self.hashes[self.hashes == 0] = 1
        breaks = np.flatnonzero(_BREAK[self.data])
        piece = np.searchsorted(breaks, self.starts)
        self.fresh = np.ones(len(self.starts), bool)
        self.fresh[1:] = (piece[1:] != piece[:-1]) | (self.text[1:] != self.text[:-1])
        self.offsets = offsets

    def said(self, places: np.ndarray) -> list[str]:
        """The words at some places, with A-Z lower-cased."""
        starts, text = self.starts[places], self.text[places]
        gaps = np.flatnonzero(_APART[self.data])
        gap = np.searchsorted(gaps, starts)
        ends = np.append(gaps, len(self.data))[gap]
        ends = np.minimum(ends, self.offsets[text + 1])
        raw = self.data.tobytes()
        return [raw[a:b].lower().decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of some batches together, for a few megabytes of text."""
    langs: list[str] = []
    texts: list[pa.Array] = []
    size = 0
    for batch in _batches(batches):
        langs += batch.column(0).to_pylist()
        texts.append(batch.column(1).cast(pa.large_string()))
        size += batch.column(1).nbytes
        if size >= HOLD_BYTES:
            yield Words(langs, pa.concat_arrays(texts))
            langs, texts, size = [], [], 0
    if langs:
        yield Words(langs, pa.concat_arrays(texts))


def count_words(texts: DataFrame) -> DataFrame:
    """(h, lang, word, n): every word of every language, its hash and how often it occurs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            hashes, first, times = np.unique(words.hashes, return_index=True, return_counts=True)
            langs = [words.langs[t] for t in words.text[first].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)),
                    pa.array(langs, pa.string()),
                    pa.array(words.said(first), pa.string()),
                    pa.array(times.astype(np.int64)),
                ],
                ["h", "lang", "word", "n"],
            )

    counted = texts.mapInArrow(step, "h long, lang string, word string, n long")
    return counted.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


class Bitmap:
    """A set of hashes in ``BITS`` bits, which may hold others that share a bit."""

    def __init__(self, hashes: DataFrame, column: str):
        place = F.pmod(F.col(column), F.lit(BITS)) + 1
        rows = (
            hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
            .toLocalIterator()
        )
        self.bytes = np.zeros(BITS // 8, np.uint8)
        for row in rows:  # of at most BITS bits in all
            part = np.frombuffer(row.bits, np.uint8)
            self.bytes[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes % np.uint64(BITS)).astype(np.int64)
        return (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def encode(texts: DataFrame, frequent: Bitmap) -> DataFrame:
    """(seq, share): hashed words in order, 0 where a piece ends or words are rare.

    ``share`` deals the rows out to ``SHARES`` by what is in them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            words = Words(batch.column(0).to_pylist(), batch.column(1))
            if not len(words.hashes):
                continue
            seq = np.where(shared.value.holds(words.hashes), words.hashes, np.uint64(0))
            seq = np.insert(seq, np.flatnonzero(words.fresh), np.uint64(0))
            seq = seq[np.append(True, (seq[1:] != 0) | (seq[:-1] != 0))]
            share = int(xxhash.xxh64_intdigest(seq.tobytes()) % SHARES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seq.view(np.int64)]), pa.array([share], pa.int32())], ["seq", "share"]
            )

    return texts.mapInArrow(step, "seq array<long>, share int")


# -- candidates -----------------------------------------------------------------------------


def names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases, from the columns of their words."""
    total = words[0] * STEP[0]
    for i, column in enumerate(words[1:], 1):
        total = total + column * STEP[i]
    return mix(total)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column(0):
            yield row.values.to_numpy().view(np.uint64)


def _folded(
    packed: DataFrame,
    schema: str,
    size: int,
    kind: type,
    add: Callable[[np.ndarray, np.ndarray, np.ndarray], None],
    done: Callable[[int, np.ndarray], pa.RecordBatch],
) -> DataFrame:
    """Counters of each part, added up from rows as by ``_packed`` as they stream by.

    A task holds the ``size`` counters of one part at a time.
    """
    ordered = packed.repartition("part").sortWithinPartitions("part")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counters = None, None
        for batch in batches:
            for part, n, steps, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                if part != current:
                    if counters is not None:
                        yield done(current, counters)
                    current, counters = part, np.zeros(size, kind)
                places = np.cumsum(np.frombuffer(steps, f"u{len(steps) // n}"), dtype=np.int64)
                add(counters, places, np.frombuffer(numbers, f"u{len(numbers) // n}").astype(kind))
        if counters is not None:
            yield done(current, counters)

    return ordered.mapInArrow(step, schema)


def _steps(places: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places as steps of two bytes, long ones cut at places of number 0; of four if many."""
    steps = np.diff(places, prepend=0)
    cuts = np.maximum(steps - 1, 0) // 0xFFFF
    if 2 * cuts.sum() > len(steps):
        return steps.astype(np.uint32), numbers
    ends = np.cumsum(cuts + 1) - 1
    short = np.full(ends[-1] + 1, 0xFFFF, np.uint16)
    short[ends] = steps - cuts * 0xFFFF
    all_numbers = np.zeros(len(short), numbers.dtype)
    all_numbers[ends] = numbers
    return short, all_numbers


def _packed(places: np.ndarray, numbers: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rising places and their numbers as a row for each part of ``2 ** bits`` places.

    Numbers take a byte; those that need more have a second row.
    """
    rows: list[tuple[int, int, bytes, bytes]] = []
    for some, kind in ((numbers < 256, np.uint8), (numbers >= 256, np.uint64)):
        at, counts = places[some], numbers[some].astype(kind)
        if not len(at):
            continue
        parts = at >> bits
        heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(at)).tolist()):
            steps, own = _steps(at[a:b] & ((1 << bits) - 1), counts[a:b])
            rows.append((int(parts[a]), len(steps), steps.tobytes(), own.tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["part", "n", "steps", "numbers"]
    )


_PACKED = "part int, n int, steps binary, numbers binary"


class Places:
    """The phrases of ``k`` words in a sequence whose parts of a word less are all frequent."""

    def __init__(self, k: int, parts: Bitmap | None):
        self.k, self.parts = k, parts

    def phrases(self, seq: np.ndarray) -> list[np.ndarray]:
        if len(seq) < self.k:
            return [np.zeros(0, np.uint64)] * self.k
        columns = [seq[i : len(seq) - self.k + 1 + i] for i in range(self.k)]
        at = np.flatnonzero(np.logical_and.reduce([c != 0 for c in columns]))
        if self.parts is not None:
            for part in (columns[:-1], columns[1:]):
                at = at[self.parts.holds(phrase_hash([c[at] for c in part]))]
        return [c[at] for c in columns]


class Safe:
    """Buckets of phrase hashes that may hold a frequent one, by the hashes' leading bits."""

    def __init__(self, seqs: DataFrame, places: Places, least: int):
        """Counts 2**32 buckets, each task's share cut off at ``least``, and keeps ``SAFE_BITS``."""
        shared = seqs.sparkSession.sparkContext.broadcast(places)
        bits = BUCKET_BITS - PART_BITS

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def packed() -> pa.RecordBatch:
                found, times = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                some = np.minimum(times, least).astype(np.uint8)
                return _packed(found.astype(np.int64), some, bits)

            for seq in _sequences(batches):
                hashes = phrase_hash(shared.value.phrases(seq))
                if len(hashes):
                    held.append((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
                if sum(map(len, held)) >= HOLD_BUCKETS:
                    yield packed()
            if held:
                yield packed()

        def add(counters: np.ndarray, at: np.ndarray, some: np.ndarray) -> None:
            counters[at] = np.minimum(counters[at] + some, least)

        def done(part: int, counters: np.ndarray) -> pa.RecordBatch:
            ready = counters >= least
            some = ready.reshape(-1, 1 << (BUCKET_BITS - SAFE_BITS)).any(axis=1)
            held = np.packbits(some, bitorder="little").tobytes()
            buckets = np.flatnonzero(ready).astype(np.uint32).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in (held, buckets)]],
                ["part", "held", "buckets"],
            )

        def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, buckets in zip(*[c.to_pylist() for c in batch.columns]):
                    own = np.frombuffer(buckets, np.uint32) + np.int64(part << bits)
                    yield pa.RecordBatch.from_arrays([pa.array(own)], ["bucket"])

        schema = "part int, held binary, buckets binary"
        sums = _folded(seqs.select("seq").mapInArrow(step, _PACKED), schema, 1 << bits, np.uint8, add, done)
        self.table = stored(sums, "phrase-buckets", free_shuffles=True)
        self.buckets = self.table.select("part", "buckets").mapInArrow(said, "bucket long")
        size = (1 << (SAFE_BITS - PART_BITS)) // 8
        self.bytes = np.zeros((1 << SAFE_BITS) // 8, np.uint8)
        for row in self.table.select("part", "held").toLocalIterator():  # of 2**SAFE_BITS bits in all
            self.bytes[row.part * size : (row.part + 1) * size] = np.frombuffer(row.held, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - SAFE_BITS)).astype(np.int64)
        return (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

    def __getstate__(self) -> dict:
        return {"bytes": self.bytes}  # tasks have no use for the tables


def _among(rising: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(hashes), bool)
    return rising[np.minimum(np.searchsorted(rising, hashes), len(rising) - 1)] == hashes


def hashes_of(phrases: DataFrame, k: int) -> DataFrame:
    """(h): the hashes of phrases of ``k`` words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy().view(np.uint64) for i in range(k)]
            hashed = phrase_hash(columns).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashed)], ["h"])

    return phrases.select(*names(k)).mapInArrow(step, "h long")


def unlisted(seqs: DataFrame, k: int, shared: Broadcast, earlier: Broadcast) -> DataFrame:
    """(w1, .., bucket): what each task lists, every phrase once and none of the ``earlier`` hashes."""
    schema = ", ".join(f"{w} long" for w in names(k)) + ", bucket long"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, safe = shared.value
        own = np.zeros(0, np.uint64)
        held: list[list[np.ndarray]] = []

        def listed() -> Iterator[pa.RecordBatch]:
            nonlocal own
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            hashes, first = np.unique(phrase_hash(columns), return_index=True)
            fresh = ~_among(earlier.value, hashes) & ~_among(own, hashes)
            hashes, first = hashes[fresh], first[fresh]
            if len(first):
                own = np.sort(np.append(own[: max(0, KNOWN - len(hashes))], hashes), kind="stable")
                arrays = [pa.array(c[first].view(np.int64)) for c in columns]
                buckets = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(buckets)], [*names(k), "bucket"])

        for seq in _sequences(batches):
            columns = given.phrases(seq)
            ready = safe.holds(phrase_hash(columns))
            if ready.any():
                held.append([c[ready] for c in columns])
            if sum(len(h[0]) for h in held) >= HOLD_PHRASES:
                yield from listed()
        if held:
            yield from listed()

    return seqs.mapInArrow(step, schema)


def list_candidates(seqs: DataFrame, k: int, parts: Bitmap | None, least: int) -> list[DataFrame]:
    """(w1, ..) for each round: phrases of ``k`` words that may occur ``least`` times in the texts.

    ``parts``: frequent phrases of a word less, None where those are words. Buckets of hashes are
    counted first; only phrases of safe buckets are listed. A round leaves out what earlier ones
    listed, as far as ``KNOWN`` hashes tell its tasks; the rest of that is dropped afterwards.
    """
    context = seqs.sparkSession.sparkContext
    safe = Safe(seqs, places := Places(k, parts), least)
    shared = context.broadcast((places, safe))
    known, begin, tables = np.zeros(0, np.uint64), 0, []
    for end in ROUNDS:
        some = seqs.where((F.col("share") >= begin) & (F.col("share") < end)).select("seq")
        earlier = context.broadcast(known)
        rows = unlisted(some, k, shared, earlier).join(safe.buckets, "bucket", "left_semi")
        rows = rows.dropDuplicates(["bucket", *names(k)]).drop("bucket")
        if len(known) >= KNOWN:  # some may not have been sent out
            for table in tables:
                rows = rows.join(table, names(k), "left_anti")
        tables.append(stored(rows, f"phrase-candidates-{k}", free_shuffles=True))
        earlier.destroy()
        begin = end
        if end < SHARES and len(known) < KNOWN:
            found = hashes_of(tables[-1], k).limit(KNOWN - len(known)).toArrow()
            known = np.sort(np.append(known, found.column(0).to_numpy().view(np.uint64)))
    discard(safe.table)
    return tables


# -- counting by tries ----------------------------------------------------------------------


class DoubleArrayTrie:
    """Phrases of ``k`` words; the i-th of the distinct rows of ``columns`` is accepted as number i.

    A word is two digits, so a step has few symbols. A state is a slot; its child by a digit is
    slot ``base[state] + digit`` if ``owner`` of that slot is the state. Children of one level are
    placed together, large families first, each where all its slots are free; only children
    fill the gaps. A base may be negative, as only slots that exist are looked at.
    """

    def __init__(self, columns: list[np.ndarray]):
        self.k = len(columns)
        self.symbols = np.unique(np.concatenate(columns))
        self.radix = math.isqrt(len(self.symbols)) + 1
        ids = [np.searchsorted(self.symbols, c) for c in columns]
        digits = [d for c in ids for d in np.divmod(c, self.radix)]
        order = np.lexsort(digits[::-1])
        digits = [d[order] for d in digits]
        self.base = np.zeros(1, np.int32)
        self.owner = np.full(1, -1, np.int32)
        state = np.zeros(len(order), np.int64)  # slot 0 is the root
        path = np.zeros(len(order), bool)  # where another prefix begins
        path[0] = True
        for digit in digits:
            fresh = path.copy()
            fresh[1:] |= digit[1:] != digit[:-1]
            slots = self._place(state[fresh], digit[fresh])
            state, path = slots[np.cumsum(fresh) - 1], fresh
        self.number = np.full(len(self.base), -1, np.int32)
        self.number[state] = order

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more += len(self.base) // 4
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.owner = np.append(self.owner, np.full(more, -1, np.int32))

    def _place(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Slots of the children of one level, given as (parent, digit) in order."""
        first = np.append(True, parents[1:] != parents[:-1])
        begins = np.append(np.flatnonzero(first), len(parents))
        sizes = np.diff(begins)
        slots = np.zeros(len(parents), np.int64)
        cursor, tier = 1, 0
        for f in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            own = digits[begins[f] : begins[f + 1]]
            if tier != (tier := len(own).bit_length()):
                cursor = 1
            while True:
                self._grow(cursor + CHUNK + self.radix)
                free = np.ones(CHUNK, bool)
                for offset in (own - own[0]).tolist():
                    free &= self.owner[cursor + offset : cursor + offset + CHUNK] < 0
                at = int(free.argmax())
                if free[at]:
                    break
                cursor += CHUNK
            base = cursor + at - int(own[0])
            self.owner[base + own] = parents[begins[f]]
            self.base[parents[begins[f]]] = base
            slots[begins[f] : begins[f + 1]] = base + own
        alone = begins[:-1][sizes == 1]
        free = np.flatnonzero(self.owner[1:] < 0)[: len(alone)] + 1
        if len(free) < len(alone):
            missing = len(alone) - len(free)
            end = len(self.owner)
            self._grow(end + missing)
            free = np.append(free, np.arange(end, end + missing))
        self.owner[free] = parents[alone]
        self.base[parents[alone]] = free - digits[alone]
        slots[alone] = free
        return slots

    def count(self, seq: np.ndarray) -> np.ndarray:
        """Numbers of all phrases accepted in a sequence."""
        if len(seq) < self.k:
            return np.zeros(0, np.int64)
        symbol = np.searchsorted(self.symbols, seq)
        known = self.symbols[np.minimum(symbol, len(self.symbols) - 1)] == seq
        high, low = np.divmod(symbol, self.radix)
        at = np.flatnonzero(known[: len(seq) - self.k + 1])
        state = np.zeros(len(at), np.int64)
        for depth in range(self.k):
            there = known[at + depth]
            at, state = at[there], state[there]
            for digit in (high, low):
                child = self.base[state] + digit[at + depth]
                inside = (child > 0) & (child < len(self.owner))
                there = inside & (self.owner[np.where(inside, child, 0)] == state)
                at, state = at[there], child[there]
        return self.number[state]


def count_phrases(seqs: DataFrame, candidates: DataFrame, k: int, least: int) -> DataFrame:
    """(w1, .., f): the candidates that occur at least ``least`` times, counted by tries."""
    spark = seqs.sparkSession
    blocks = max(1, -(-candidates.count() // TRIE_PHRASES))
    placed = candidates.withColumn("block", F.pmod(F.xxhash64(*names(k)), F.lit(blocks)))
    schema = ", ".join(f"{w} long" for w in names(k)) + ", f long"
    counted = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).drop("block").toArrow()
        if not rows.num_rows:
            continue
        columns = [c.to_numpy().view(np.uint64) for c in rows.columns]
        trie = spark.sparkContext.broadcast((DoubleArrayTrie(columns), columns))

        def step(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            automaton, phrases = trie.value
            counts = np.zeros(len(phrases[0]), np.int64)
            for seq in _sequences(batches):
                counts += np.bincount(automaton.count(seq), minlength=len(counts))
            seen = np.flatnonzero(counts)
            if len(seen):
                yield _packed(seen, counts[seen], COUNT_BITS)

        def add(counters: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> None:
            counters[at] += numbers

        def done(part: int, counters: np.ndarray, trie=trie) -> pa.RecordBatch:
            often = np.flatnonzero(counters >= least)
            said = [pa.array(c[often + (part << COUNT_BITS)].view(np.int64)) for c in trie.value[1]]
            return pa.RecordBatch.from_arrays([*said, pa.array(counters[often])], [*names(k), "f"])

        packed = seqs.select("seq").mapInArrow(step, _PACKED)
        sums = _folded(packed, schema, 1 << COUNT_BITS, np.int64, add, done)
        counted = counted.union(stored(sums, f"phrases-{k}", free_shuffles=True))
        trie.destroy()
    return counted


def bitmap_of(phrases: DataFrame, k: int) -> Bitmap:
    """The frequent phrases of ``k`` words, as a set for the next level's filter."""
    return Bitmap(hashes_of(phrases, k), "h")


# -- scores ---------------------------------------------------------------------------------


def _exact(count: Column) -> Column:
    return count.cast("decimal(19,0)")


def _with_parts(phrases: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Phrases of ``k`` words with their lang, and counts l1, r1, .. of the parts of every cut.

    ``shorter``: the same of all frequent phrases of a word less.
    """
    own, less = names(k), names(k - 1)
    heads = [F.col(f"l{cut}") for cut in range(1, k - 1)] + [F.col("f").alias(f"l{k - 1}")]
    tails = [F.col("f").alias("r1")] + [F.col(f"r{cut}").alias(f"r{cut + 1}") for cut in range(1, k - 1)]
    head = shorter.select(*less, "lang", *heads)
    tail = shorter.select(*[F.col(x).alias(y) for x, y in zip(less, own[1:])], *tails)
    return phrases.join(head, own[:-1]).join(tail, own[1:])


def _scored(rows: DataFrame, k: int) -> DataFrame:
    """Phrases of ``k`` words with ``a`` and the l, r and score of their weakest cut."""
    square = _exact(F.col("f")) * _exact(F.col("f")) * F.lit(SCALE)
    options = []
    for cut in range(1, k):
        product = _exact(F.col(f"l{cut}")) * _exact(F.col(f"r{cut}"))
        score = F.call_function("div", square, product)
        options.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    rows = rows.withColumn("m", F.array_min(F.array(*options)))
    return rows.select("lang", *names(k), F.col("f").alias("a"), "m.l", "m.r", "m.score")


def _free_standing(rows: DataFrame, longer: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Without the phrases that mostly occur within a longer candidate.

    ``longer``: those of one word more, which hold all others and occur at least as often.
    """
    if longer is None:
        return rows
    own, more = names(k), names(k + 1)
    inner = [longer.select(*[F.col(x).alias(y) for x, y in zip(w, own)], "f") for w in (more[:-1], more[1:])]
    most = inner[0].union(inner[1]).groupBy(*own).agg(F.max("f").alias("most"))
    held = F.coalesce(F.col("most") * 100 >= F.col("f") * percent, F.lit(False))
    return rows.join(most, own, "left").where(~held).drop("most")


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
) -> tuple[DataFrame, dict[int, DataFrame]]:
    """All words (h, lang, word, n), and by length the frequent phrases (w1, .., f), 1 with lang."""
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = stored(count_words(texts), "phrase-words", free_shuffles=True)
    frequent = words.where(F.col("n") >= least)
    levels = {1: frequent.select(F.col("h").alias("w1"), "lang", F.col("n").alias("f"))}
    # The words of a task's file fit in a dictionary: some two bytes a word, where plain longs are eight.
    packed = {"compression": "zstd", "parquet.dictionary.page.size": str(4 << 20)}
    seqs = stored(encode(texts, Bitmap(frequent, "h")), "phrase-seqs", **packed)
    for k in range(2, most_words + 1):
        parts = bitmap_of(levels[k - 1], k - 1) if k > 2 else None
        listed = list_candidates(seqs, k, parts, least)
        levels[k] = count_phrases(seqs, reduce(DataFrame.union, listed), k, least)
        for table in listed:
            discard(table)
    discard(seqs)
    return words, levels


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    inside_percent: int = INSIDE_PERCENT,
    first: int = FIRST,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut with the lowest score
    ``SCALE * a * a / (l * r)``, and ``n`` all words of the language.
    """
    words, levels = mine(docs, text_col, lang_col, least, most_words)
    found, rows = [], levels[1]
    for k in range(2, most_words + 1):
        rows = stored(_with_parts(levels[k], rows, k), f"phrase-parts-{k}", free_shuffles=True)
        free = _scored(_free_standing(rows, levels.get(k + 1), k, inside_percent), k)
        said = F.array(*names(k)).alias("words")
        found.append(free.select("lang", said, "a", "l", "r", "score"))
    order = [F.desc("score"), F.desc("a")]
    best = Window.partitionBy("lang").orderBy(*order)
    near = reduce(DataFrame.union, found).withColumn("rank", F.rank().over(best)).where(F.col("rank") <= first)
    near = stored(near.drop("rank"), "phrase-first", free_shuffles=True)
    spoken = near.select("words", F.posexplode("words").alias("at", "h")).join(words.select("h", "word"), "h")
    spoken = spoken.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said"))
    phrases = near.join(spoken.select("words", F.concat_ws(" ", "said.word").alias("phrase")), "words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = phrases.withColumn("rank", place).where(F.col("rank") <= first)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
