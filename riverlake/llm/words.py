"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. As no
such byte occurs inside a character of UTF-8, bytes and characters give the same words. Two
different words or shingles of a document share a hash with probability 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21  # bytes hashed at a time, cut between words

_draw = np.random.default_rng(20240229)


def _random(n: int) -> np.ndarray:
    return _draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _random(256)[_LOWER]
_PLACE = _random(4096)
STEP = _random(64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each hang on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts without nulls, and where each text begins."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _block_words(
    data: np.ndarray, heads: np.ndarray, space: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; ``heads``: places where a text begins."""
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else (
        np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
    )
    weight = _PLACE[place & 4095]
    if place.max() > 4095:
        weight = weight * ((place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    values = _BYTE[data] * weight
    values[~word] = 0
    return starts, mix(np.add.reduceat(values, starts))


def located_words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words in order, for texts as by ``text_bytes``.

    ``space`` marks the bytes that are in no word, all of them below 0x80.
    """
    starts, hashes, begin = [], [], 0
    while begin < len(data):
        stop = min(begin + BLOCK_BYTES, len(data))
        while stop < len(data):  # to the next space or head of a text
            ahead = np.flatnonzero(space[data[stop : stop + 65536]])
            head = offsets[np.searchsorted(offsets, stop)]
            stop = min(stop + (int(ahead[0]) if len(ahead) else 65536), int(head))
            if len(ahead) or stop == head:
                break
        stop = min(stop, len(data))
        heads = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop)]
        at, hashed = _block_words(data[begin:stop], np.unique(heads - begin), space)
        starts.append(at + begin)
        hashes.append(hashed)
        begin = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which word each text begins (one more at the end)."""
    data, offsets = text_bytes(texts)
    starts, hashes = located_words(data, offsets)
    return hashes, np.searchsorted(starts, offsets, "left")


def shingle_sets(words: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``n`` words, sorted; with fewer words, one of all."""
    whole = np.zeros(0, np.uint64)
    if len(words) >= n:
        whole = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            whole += words[k : len(words) - n + 1 + k] * STEP[k]
        whole = mix(whole)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= n:
            grams = np.sort(whole[begin : end - n + 1])
            fresh = np.ones(len(grams), bool)
            np.not_equal(grams[1:], grams[:-1], out=fresh[1:])
            yield grams if fresh.all() else grams[fresh]
        elif end > begin:
            few = np.uint64(end - begin) * STEP[-1]
            with np.errstate(over="ignore"):
                for k in range(end - begin):
                    few += words[begin + k] * STEP[k]
            yield mix(np.array([few], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
