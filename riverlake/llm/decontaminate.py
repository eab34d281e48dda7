"""Benchmark decontamination by SimHash over windows the size of the items.

Every item is searched for in all documents. However the edits of a passage are spread, the
threshold leaves a run of unchanged words whose least length follows from the item's
(``clean_run``). Windows of a size from a grid overlap over the item so that one of them lies in
any such run. They, and the windows of that size at every word of every document, get a 64-bit
SimHash of their words. Fingerprints within
``RADIUS`` bits are found by a multi-index: split into ``RADIUS + 1`` blocks, two of them that
differ in at most ``RADIUS`` bits are equal in a block, so looking up each block misses none.
Then all passages of the document around the windows are compared with the item by the weighted
Jaccard similarity of their 5-word shingles (a shingle weighs as often as it occurs), exactly.

Items are handled in blocks of at most ``ITEM_BLOCK`` and ``BLOCK_CHARS`` (a longer item is a block
of its own), with a pass over the documents for each, so what goes to the executors has a bound. Documents are scanned in stretches of words.

Defined results: rows are pairs of a document and an item, the best passage for each. Items
without words, without text or without an id match nothing; items of equal text all match. An
item of fewer than five words matches where its words are said in order. Of passages that are
equally similar the first that begins is taken, then the longest. Null texts have no passages. An
empty table of documents or items gives no rows. Texts and items of any length are read whole. Repeated rows give one row, and rows without an id give one of a null id. Extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlake.llm.rows import BATCH_ROWS, over_texts, spare, stored
from riverlake.llm.words import STEP, mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 3
ITEM_BLOCK = 20_000
BLOCK_CHARS = 16_000_000
STRETCH = 1 << 16  # words fingerprinted at a time
SIZES = [1, 2, 3, 4, 5, 6, 9, 13, 19, 28, 42, 63, 95, 142, 213]

_SCHEMA = "id long, item_id long, similarity double, start_word long, n_words long"


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all 5-word shingles in order; with fewer words, one of the sequence."""
    k = min(SHINGLE, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * STEP[i]
    return mix(out) if k == SHINGLE else mix(out + STEP[-1] * np.uint64(k))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def clean_run(words: int) -> int:
    """Least length of the longest unchanged run of an item in a passage at the threshold.

    ``k`` separate edits that take ``m`` words cost an item of ``n`` shingles ``m + 4 k`` of them
    and add at least ``4 k`` others, so ``n - m - 4 k >= THRESHOLD (n + 4 k)``, and what is left
    of the item is in ``k + 1`` runs.
    """
    n = max(0, words - SHINGLE + 1)
    room, each = (1 - THRESHOLD) * n, (1 + THRESHOLD) * (SHINGLE - 1)
    runs = [-(-(words - int(room - each * k)) // (k + 1)) for k in range(int(room / each) + 1)]
    return min(runs)


def windows_of(words: int) -> tuple[int, list[int]]:
    """Size and offsets of windows, one of which lies in any run of ``clean_run`` words."""
    run = clean_run(words)
    room = (run + 1) * 3 // 4 if run >= 13 else run
    size = max(size for size in SIZES if size <= room)
    last = words - size
    return size, sorted({*range(0, last + 1, run - size + 1), last})


def fingerprints(running: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` words, from running sums of the words' bits."""
    ones = running[size:] - running[:-size]  # modulo 256, which no size exceeds
    return np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()


def running_bits(words: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=out[1:])
    return out


class BlockIndex:
    """Fingerprints by each of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        width = 64 // (RADIUS + 1)
        self.mask = np.uint64((1 << width) - 1)
        for block in range(RADIUS + 1):
            shift = np.uint64(block * width)
            keys = (prints >> shift) & self.mask
            order = np.argsort(keys, kind="stable")
            known = np.zeros(1 << width, bool)
            known[keys] = True
            self.tables.append((shift, known, keys[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in ``prints``, place in the index) that differ in at most RADIUS bits."""
        places, entries = [], []
        for shift, known, keys, order in self.tables:
            own = (prints >> shift) & self.mask
            at = np.flatnonzero(known[own])
            low = np.searchsorted(keys, own[at], "left")
            many = np.searchsorted(keys, own[at], "right") - low
            place = np.repeat(at, many)
            first = np.repeat(low - (np.cumsum(many) - many), many)
            entry = order[first + np.arange(len(place))]
            close = np.bitwise_count(prints[place] ^ self.prints[entry]) <= RADIUS
            places.append(place[close])
            entries.append(entry[close])
        pairs = np.concatenate(places) * len(self.prints) + np.concatenate(entries)
        return np.divmod(np.unique(pairs), len(self.prints))


class Items:
    """The items of a block: their shingles, and an index of their windows for each size."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, bounds = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.counts = ids, np.diff(bounds)
        own = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.shingles = [Counter(shingles(w).tolist()) for w in own]
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for item, sequence in enumerate(own):
            if not len(sequence):
                continue
            size, places = windows_of(len(sequence))
            prints = fingerprints(running_bits(sequence), size)
            for offset in places:
                windows.setdefault(size, []).append((int(prints[offset]), item, offset))
        self.sizes = {
            size: (
                BlockIndex(np.array([w[0] for w in found], np.uint64)),
                np.array([w[1] for w in found]),
                np.array([w[2] for w in found]),
            )
            for size, found in windows.items()
        }

    def _said(self, words: np.ndarray, item: int, start: int) -> tuple:
        """Whether an item of fewer than ``SHINGLE`` words is said in order from a word on."""
        n = int(self.counts[item])
        same = start >= 0 and self.shingles[item] == Counter(shingles(words[start : start + n]).tolist())
        return (float(same), -start, n)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple]:
        """Best (similarity, -start, length) by (text, item)."""
        places: dict[tuple[int, int], set[int]] = {}  # where items would begin in their text
        longest = max(self.sizes, default=1)
        for begin in range(0, len(words), STRETCH):
            stretch = words[begin : begin + STRETCH + longest - 1]
            running = running_bits(stretch)
            for size, (index, items, offsets) in self.sizes.items():
                if len(stretch) < size:
                    continue
                place, entry = index.near(fingerprints(running, size)[:STRETCH])
                text = np.searchsorted(bounds, place + begin, "right") - 1
                inside = place + begin + size <= bounds[text + 1]
                at, e, t = place[inside] + begin, entry[inside], text[inside]
                start = at - bounds[t] - offsets[e]
                # Text, item and start in one number, each place once.
                packed = np.unique(((t * len(self.ids) + items[e]) << 32) + (start + (1 << 31)))
                pairs, starts = packed >> 32, (packed & 0xFFFFFFFF) - (1 << 31)
                for pair, own in _runs(pairs, starts):
                    places.setdefault(divmod(pair, len(self.ids)), set()).update(own)
        found: dict[tuple[int, int], tuple] = {}
        for (t, item), starts in places.items():
            own, n = words[bounds[t] : bounds[t + 1]], int(self.counts[item])
            if n < SHINGLE:
                best = max(self._said(own, item, start) for start in starts)
            else:
                reach = max(2, n // 3)
                best = max(
                    best_passage(self.shingles[item], own[first:last], first)
                    for first, last in _joined(sorted(starts), reach, n, len(own))
                )
            if best[0] >= THRESHOLD:
                found[t, item] = best
        return found


def _runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """The values of each key, where equal keys stand together."""
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]):
        yield int(keys[a]), values[a:b].tolist()


def _joined(starts: list[int], reach: int, n: int, length: int) -> list[tuple[int, int]]:
    """Regions of a text around the places of an item, those that overlap as one."""
    regions: list[list[int]] = []
    for start in starts:
        first, last = max(0, start - reach), min(length, start + n + reach)
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], last)
        else:
            regions.append([first, last])
    return [(first, last) for first, last in regions]


def best_passage(item: Counter, words: np.ndarray, first: int) -> tuple:
    """The passage of some words that is most similar to an item, (0.0, 0, 0) if none reaches the threshold.

    Memory and, but for the last case, time grow with the number of words. A share ``p / q`` is
    reached by some passage if ``(p + q) shared - p place`` rises by ``p n`` from its start to its
    stop, so a running minimum tells; the passage that rises most gives the next, higher share
    until none is higher. There a shingle counts each time it is said. Where that is too high,
    as it is said more often than in the item, each start is tried with exact counts.
    """
    around = shingles(words) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    if not len(around):
        return (0.0, 0, 0)
    n = sum(item.values())
    codes, inverse = np.unique(around, return_inverse=True)
    room = np.array([item.get(x, 0) for x in codes.tolist()], np.int64)
    shared = np.append(0, np.cumsum(room[inverse] > 0)).astype(np.int64)
    place = np.arange(len(shared), dtype=np.int64)
    p, q = int(THRESHOLD * 4), 4
    start = stop = 0
    while True:
        rise = (p + q) * shared - p * place
        low = np.minimum.accumulate(rise[:-1])
        gain = rise[1:] - low
        if gain.max() < p * n or (stop and gain.max() == p * n):
            break
        lowest = np.append(True, rise[1:-1] < low[:-1])  # where a new minimum is
        begins = np.maximum.accumulate(np.where(lowest, place[:-1], 0))
        stops = np.flatnonzero(gain == gain.max())
        best = stops[np.argmin(begins[stops])]
        start, stop = int(begins[best]), int(best) + 1
        p = int(shared[stop] - shared[start])
        q = n + stop - start - p
    if not stop:
        return (0.0, 0, 0)
    value = similarity(item, Counter(around[start:stop].tolist()))
    if value * q >= p * (1 - 1e-12):
        return (value, -(first + start), stop - start + SHINGLE - 1)
    return _by_each_start(around, inverse, room, n, first)


def _by_each_start(
    around: np.ndarray, inverse: np.ndarray, room: np.ndarray, n: int, first: int
) -> tuple:
    """The best passage with exact counts. A similar one is at most ``n / THRESHOLD`` shingles long."""
    order = np.argsort(inverse, kind="stable")
    at = np.bincount(inverse, minlength=len(room))
    times = np.empty(len(around), np.int64)  # how often its shingle was said before a place
    times[order] = np.arange(len(around)) - np.repeat(np.cumsum(at) - at, at)
    widest = int(n / THRESHOLD) + 1
    gone = np.zeros(len(room), np.int64)
    best = (0.0, 0, 0)
    for start in range(len(around)):
        own = inverse[start : start + widest]
        both = np.cumsum(times[start : start + widest] - gone[own] < room[own])
        values = both / (n + np.arange(1, len(own) + 1) - both)
        stop = int(values.argmax())
        best = max(best, (float(values[stop]), -(first + start), stop + SHINGLE))
        gone[inverse[start]] += 1
    return best if best[0] >= THRESHOLD else (0.0, 0, 0)


def _pass(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [
                (ids[text], items.ids[item], value, -start, length)
                for (text, item), (value, start, length) in items.search(
                    *word_hashes(batch.column(1))
                ).items()
            ]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["id", "item_id", "similarity", "start_word", "n_words"],
            )

    return over_texts(docs, id_col, text_col, _SCHEMA, step)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Items]:
    """The distinct items, at most ITEM_BLOCK and about BLOCK_CHARS of text at a time."""
    listed = (
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
        .dropna()
        .distinct()
        .orderBy("item", "text")
    )
    block: list[tuple[int, str]] = []
    size = 0
    for row in listed.toLocalIterator():
        if block and (len(block) >= ITEM_BLOCK or size + len(row.text) > BLOCK_CHARS):
            yield Items(*map(list, zip(*block)))
            block, size = [], 0
        block.append((row.item, row.text))
        size += len(row.text)
    if block:
        yield Items(*map(list, zip(*block)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(document, item_id, similarity, start_word, n_words) of items found in documents."""
    hits = docs.sparkSession.createDataFrame([], _SCHEMA)
    for items in _blocks(benchmark, item_col, item_text_col):
        hits = hits.union(stored(_pass(docs, items, id_col, text_col), "leaks"))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words")).alias("b")
    return hits.groupBy("id", "item_id").agg(best).select(
        F.col("id").alias(id_col),
        "item_id",
        "b.similarity",
        (-F.col("b.s")).alias("start_word"),
        "b.n_words",
    )


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""

    def clean(rows: DataFrame, items: Items) -> DataFrame:
        given = rows.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(spare(rows, "text_to_search")))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    keep = np.ones(part.num_rows, bool)
                    found = items.search(*word_hashes(part.column(part.num_columns - 1)))
                    keep[[text for text, _ in found]] = False
                    kept = part.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

        return given.mapInArrow(step, rows.schema)

    kept = docs
    for items in _blocks(benchmark, item_col, item_text_col):
        # What the block before kept is written first, so that one block is in use at a time.
        kept = clean(docs if kept is docs else stored(kept, "leaks-kept"), items)
    return kept
