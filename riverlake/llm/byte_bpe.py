"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into the matches of a split pattern, which are encoded on their own. A long
match is encoded half by half, and two encoded neighbours are joined by encoding a window of
tokens around the seam anew. A token sequence is the encoding of its bytes if and only if
every two neighbours are the encoding of theirs: until the first merge across a boundary,
each side of it evolves as it would alone. So a window that gives back its own first and
last token leaves all tokens outside of it as they are; one that doesn't is doubled.

Defined results: a null text is empty and has no ids; repeated rows give equal rows; an empty
table gives an empty table. Two pairs of tokens of equal rank are the same tokens, and the
leftmost is merged first. A long text is encoded in blocks, and rows reach Python in batches of
bounded bytes. Extra columns are kept by the encoder and the decoder unless they have the name
of an output column (in any case of letters), which replaces them.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from riverlake.llm.rows import small_batches, spare

PASS_ROWS = 100  # whose results are held at a time
LEAF_BYTES = 48  # encoded directly; a longer piece is halved
CACHE_BYTES = 64 << 20  # of the cache of pieces, about
ENTRY_BYTES = 110  # of an entry, besides its ids and characters
CACHED_CHARS = 64
BLOCK_CHARS = 1 << 18  # of a text that are handled at a time
NO_RANK = 1 << 40

# White space of the split patterns (Unicode White_Space, which Python's own class exceeds).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A space after anything else: no match of a split pattern reaches across this place.
CUT = re.compile(f"(?<=[^{SPACE}]) ")


def blocks(text: str) -> Iterator[str]:
    """The text in pieces of bounded size, cut where no match of the pattern is."""
    start = 0
    while len(text) - start > BLOCK_CHARS and (cut := CUT.search(text, start + BLOCK_CHARS)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_leaf(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """Encode a few bytes: merge the leftmost pair of lowest rank until none is left."""
    get = ranks.get
    bounds = list(range(len(piece) + 1))
    found = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while found and (lowest := min(found)) < NO_RANK:
        at = found.index(lowest)
        del bounds[at + 1], found[at]
        if at < len(found):
            found[at] = get(piece[bounds[at] : bounds[at + 2]], NO_RANK)
        if at:
            found[at - 1] = get(piece[bounds[at - 1] : bounds[at + 1]], NO_RANK)
    return [piece[a:b] for a, b in zip(bounds, bounds[1:])]


def merge_window(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The same for many bytes: candidate pairs in a heap, parts in a linked list."""
    if len(piece) <= 2 * LEAF_BYTES:
        return merge_leaf(ranks, piece)
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if not alive[at] or middle >= n or not alive[middle] or end[middle] != stop:
            continue  # one of its parts has been merged since
        alive[middle] = 0
        end[at] = stop
        if stop < n:
            before[stop] = at
            if (rank := ranks.get(piece[at : end[stop]])) is not None:
                heapq.heappush(heap, (rank, at, end[stop]))
        left = before[at]
        if left >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def join(ranks: dict[bytes, int], left: list[bytes], right: list[bytes]) -> list[bytes]:
    """The encoding of two encoded neighbours together."""
    if not left or not right:
        return left or right
    width = 2
    while True:
        head, tail = left[-width:], right[:width]
        whole = len(head) == len(left) and len(tail) == len(right)
        again = merge_window(ranks, b"".join(head) + b"".join(tail))
        keeps_head = len(head) == len(left) or again[0] == head[0]
        keeps_tail = len(tail) == len(right) or again[-1] == tail[-1]
        if whole or keeps_head and keeps_tail:
            return left[: len(left) - len(head)] + again + right[len(tail) :]
        width *= 2


def encode_piece(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    if len(piece) <= LEAF_BYTES:
        return merge_leaf(ranks, piece)
    half = len(piece) // 2
    return join(ranks, encode_piece(ranks, piece[:half]), encode_piece(ranks, piece[half:]))


class Cache(dict):
    """Ids of pieces as bytes, made when first asked for, in about ``CACHE_BYTES``.

    When half of that is full it becomes the older half, from which what is asked for again
    comes back; the rest goes with the next change. So frequent pieces stay.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older, self.room = make, {}, CACHE_BYTES // 2

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            self.room -= ENTRY_BYTES + getsizeof(piece) + getsizeof(ids)
            if self.room < 0:
                self.older, self.room = dict(self), CACHE_BYTES // 2
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts. Short pieces are cached; a long text is handled in blocks."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = load_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.cache = Cache(self.piece_ids)

    def piece_ids(self, match: str) -> bytes:
        piece = match.encode("utf-8")
        if (rank := self.ranks.get(piece)) is not None:
            ids = [rank]  # a piece in the vocabulary is a token as it is
        else:
            ids = [self.ranks[part] for part in encode_piece(self.ranks, piece)]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> array:
        ids = array("i")
        for block in blocks(text):
            ids.frombytes(b"".join(map(self.cache.__getitem__, self.split(block))))
        return ids


@lru_cache(maxsize=1)
def worker_encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for all tasks that a worker runs, which go on with what the last ones cached."""
    return Encoder(ranks_path, pattern)


class Decoder:
    """The bytes of ids: tokens by their rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: token for token, rank in ranks.items()}.__getitem__

    def decode(self, ids: array | list[int]) -> bytes:
        return joined_up(list(map(self.token, ids)))


def _pass(
    df: DataFrame,
    names: list[str],
    read: str,
    outs: list[StructField],
    work: Callable[[], Callable[[pa.Scalar], tuple]],
) -> DataFrame:
    """Columns ``names`` of ``df`` and one more for each of ``outs``, made from ``read`` row by row.

    An output column replaces an input column of its name.
    """
    small_batches(df.sparkSession)
    taken = {out.name.lower() for out in outs}
    names = [c for c in names if c.lower() not in taken]
    given = df.select(*[F.col(f"`{c}`") for c in names], F.col(read).alias(spare(df, "given_value")))
    schema = StructType([*given.schema.fields[:-1], *outs])
    kinds = to_arrow_schema(StructType(outs)).types

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            for start in range(0, batch.num_rows, PASS_ROWS):
                part = batch.slice(start, PASS_ROWS)
                made = zip(*[make(value) for value in part.column(part.num_columns - 1)])
                columns = [pa.array(list(c), k) for c, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], schema.names)

    return given.mapInArrow(step, schema)


def encode_texts(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    out_col: str = "token_ids",
    keep: list[str] | None = None,
    decoded_col: str | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with the ids of each text as an array of int.

    With ``decoded_col`` the same pass decodes the ids again and adds their bytes, so that one
    vocabulary serves both. ``ranks_path`` is a file of base64 tokens and ranks that every
    executor has.
    """
    outs = [StructField(out_col, ArrayType(IntegerType()))]
    if decoded_col is not None:
        outs.append(StructField(decoded_col, BinaryType()))

    def work() -> Callable[[pa.Scalar], tuple]:
        encoder = worker_encoder(ranks_path, pattern)
        decode = Decoder(encoder.ranks).decode

        def make(value: pa.Scalar) -> tuple:
            ids = encoder.encode(value.as_py() or "")
            held = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
            return (held,) if decoded_col is None else (held, decode(ids))

        return make

    return _pass(df, df.columns if keep is None else keep, text_col, outs, work)


def joined_up(parts: list[bytes]) -> bytes:
    """Concatenate neighbours, then their neighbours, up to the root."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 4096]) for i in range(0, len(parts), 4096)]
    return parts[0] if parts else b""


def decode_tokens(
    df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded"
) -> DataFrame:
    """``df`` with the bytes of each array of ids; null ids give null."""

    def work() -> Callable[[pa.Scalar], tuple]:
        decode = Decoder(load_ranks(ranks_path)).decode
        return lambda ids: (decode(ids.values.to_pylist()) if ids.is_valid else None,)

    return _pass(df, df.columns, ids_col, [StructField(out_col, BinaryType())], work)
