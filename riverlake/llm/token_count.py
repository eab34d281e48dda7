"""Token counts by byte-pair merging over a heap and a linked list.

The vocabulary is a tokenizer file with lower-casing, word ends and byte symbols. A word's
symbols form a linked list; the adjacent pair of lowest rank is popped from a heap and merged,
again and again. The count is the number of symbols at the start minus the number of merges:
no identifier is looked up. Special strings inside a text count as one token each.

Defined results: a null text is empty and has no tokens; repeated rows give equal rows; an
empty table gives an empty table; no other input column is read or returned.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlake.llm.byte_bpe import blocks
from riverlake.llm.rows import over_texts

CACHE_ENTRIES = 250_000  # the cache of pieces is emptied at this size
CACHED_CHARS = 64
PAIR = 1 << 20  # more than any vocabulary has symbols


def byte_letters() -> list[str]:
    """The printable character that stands for each byte, by the usual byte-level rule."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(pair) for pair in model["merges"]]
        self.pair_rank = {vocab[a] * PAIR + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.product = [vocab[a + b] for a, b in merges]
        letters = byte_letters()
        self.inner = [vocab[letter] for letter in letters]
        self.final = [vocab[letter + model["end_of_word_suffix"]] for letter in letters]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.cache: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece: its symbols minus the merges."""
        data = piece.encode("utf-8")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        rank_of, product = self.pair_rank.get, self.product
        count = n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            rank * n + i
            for i in range(n - 1)
            if (rank := rank_of(symbols[i] * PAIR + symbols[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, at = divmod(heapq.heappop(heap), n)
            other = after[at]
            if other >= n or rank_of(symbols[at] * PAIR + symbols[other]) != rank:
                continue  # one of the two has been merged since
            symbols[at], symbols[other] = product[rank], -PAIR
            after[at] = right = after[other]
            count -= 1
            if right < n:
                before[right] = at
                if (new := rank_of(symbols[at] * PAIR + symbols[right])) is not None:
                    heapq.heappush(heap, new * n + at)
            if (left := before[at]) >= 0:
                if (new := rank_of(symbols[left] * PAIR + symbols[at])) is not None:
                    heapq.heappush(heap, new * n + left)
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of text without special strings."""
        # Lower-casing goes letter by letter: a sigma at the end of a word is no exception.
        folded = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        get, compute = self.cache.get, self.merged
        return sum([get(piece) or compute(piece) for piece in self.split(folded)])

    def count(self, text: str) -> int:
        total = 0
        for block in blocks(text):
            total += len(self.special.findall(block))
            total += sum(map(self.plain, self.special.split(block)))
        return total


def count_tokens(
    df: DataFrame,
    path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, bytes of UTF-8, tokens, and whether these exceed ``limit``.

    ``path`` is a tokenizer file that every executor has.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            texts = batch.column(1)
            counts, sizes = [], []
            for start in range(0, batch.num_rows, 500):
                for text in texts.slice(start, 500).to_pylist():
                    counts.append(counter.count(text))
                    sizes.append(len(text.encode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    counted = over_texts(df, id_col, text_col, "id long, n_bytes long, n_tokens long", step)
    return counted.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > F.lit(limit)).alias("over_limit"),
    )
