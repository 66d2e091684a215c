"""Vectorised words, word hashes and shingles over the bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: space, tab, LF, VT, FF, CR
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are worked on at once; only a longer word or text takes more.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK + 1, n)
    if size not in _powers:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > BLOCK + 1:
            return made[0], made[1]
        _powers[size] = made[0], made[1]
    return _powers[size]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(buf: np.ndarray, offs: np.ndarray, limit: int = BLOCK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of about limit bytes and no more than so many rows."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def split_words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words, and where each text's words begin among them (len + 1)."""
    word = ~space[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    begins = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return begins, ends, np.searchsorted(begins, offs)


def hash_words(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + BLOCK, "right")))
        low, high = int(begins[i]), int(ends[j - 1])
        p, q = powers(high - low + 1)
        c = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTER[buf[low:high]] * p[: high - low], out=c[1:])
        out[i:j] = (c[ends[i:j] - low] - c[begins[i:j] - low]) * q[begins[i:j] - low]
        i = j
    return mix64(out)


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each k consecutive words; those across two texts are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n] * _PLACE[0]
    for j in range(1, k):
        g += h[j : j + n] * _PLACE[j]
    return mix64(g + np.uint64(k))


def whole(h: np.ndarray) -> np.uint64:
    """64 bits for a sequence of words of any length; unlike any of grams() by its length."""
    at = mix64(np.arange(len(h), dtype=np.uint64) + np.uint64(1000)) | np.uint64(1)
    return mix64(np.array([(h * at).sum(dtype=np.uint64) + np.uint64(0xABCDEF) * np.uint64(len(h) + 977)], np.uint64))[0]
