"""Words of Arrow string columns as numpy arrays, without a Python object per word.

A word is a longest run of bytes other than space and 0x09-0x0D. All six are
ASCII, so the rule is the same on UTF-8 bytes and on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Native pattern of what separates words, for Spark's and Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_RNG = np.random.default_rng(20240229)
_BYTES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)]
_ROLL = np.uint64(0xD1342543DE82EF95)
_ROLL_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of text; a longer text is a slice of its own. At the end Arrow's unused memory is given back, as workers wait for further tasks."""
    for batch in batches:
        size = np.cumsum(np.diff(raw(batch.column(batch.schema.get_field_index(text)))[1]))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, done + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(size[end - 1])
    pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the number of words before each text and in all."""
    word = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate((word[1:], [False])) if len(data) else word
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` chooses one of two hashes that don't depend on each other."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()), _BASES[which]))), dtype=np.uint64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = within + np.repeat(start, size)
    return mix(np.add.reduceat(_BYTES[which][data[at]] * powers[within], np.cumsum(size) - size) + size.astype(np.uint64))


def rolling(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive values of ``words``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count = len(words)
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(count - 1, _ROLL))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(count - n, _ROLL_INV))), dtype=np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(words + np.uint64(seed)) * up, dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * down)
