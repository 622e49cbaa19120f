"""Hashed word shingles of Arrow text columns, vectorised over the bytes of a batch.

Words are runs of anything but ASCII white space, compared with A-Z in lower case. A word's hash is a
polynomial over its bytes modulo 2**64 (byte values from a fixed random table), taken for all words at
once from running sums; a shingle's hash mixes those of its words. Texts are whole; a batch is worked
through in pieces of about a megabyte, and a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    size = 0

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            up, down = _powers(_BASE, max(n, PIECE)), _powers(_INVERSE, max(n, PIECE))
            if n > 4 * PIECE:
                return up, down  # of one very long text: not kept
            cls.size, cls.up, cls.down = len(up), up, down
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each document's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | edge[1:n]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _Tables.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, values = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingled(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingle hashes, each row's first shingle and one more at the end).

    A text with fewer words than ``width`` has its whole sequence as the only shingle, one without words
    has none. Hashes stand in text order and may repeat.
    """
    for at, to, data, offsets in pieces(texts):
        words, first = _words(data, offsets)
        count = np.diff(first)
        full = max(len(words) - width + 1, 0)
        acc = np.zeros(full, np.uint64)
        for k in range(width):
            acc = (acc + words[k : k + full]) * _STEP
        doc = np.repeat(np.arange(to - at), count)
        inside = doc[:full] == doc[len(doc) - full :]
        found = mixed(acc[inside])
        own = np.maximum(count - width + 1, 0)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                has = count[short] > k
                whole[has] = (whole[has] + words[first[:-1][short[has]] + k]) * _STEP
            whole = mixed(whole ^ mixed(count[short].astype(np.uint64) + np.uint64(1)))
            place = np.concatenate([[0], np.cumsum(own)])[short]
            found = np.insert(found, place, whole)
            own[short] = 1
        yield at, to, found, np.concatenate([[0], np.cumsum(own)])


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for at, to, found, first in shingled(texts, width):
        for k in range(to - at):
            yield np.unique(found[first[k] : first[k + 1]])
