"""Words and word shingles of a batch of texts as 64-bit numbers, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .common import utf8

SHINGLE = 5
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(2).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, runs of anything but ASCII white space, and the row limits among them."""
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = limits[(limits > 0) & (limits < len(data))]
    begins[inner] = solid[inner]  # a row's first word doesn't go on from the row before
    at = np.flatnonzero(begins)
    rows = np.searchsorted(at, limits)
    if not len(at):
        return np.zeros(0, np.uint64), rows
    body = np.flatnonzero(solid)
    first = np.searchsorted(body, at)
    lengths = np.diff(np.append(first, len(body)))
    place = np.arange(len(body)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    total = np.add.reduceat(_BYTE[data[body]] * powers[place], first)
    return mix(total + lengths.astype(np.uint64)), rows


def rows_in_blocks(text: pa.Array, block: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, limits) in blocks of bounded size, one row at least."""
    data, limits = utf8(text)
    row, n = 0, len(text)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(limits, limits[row] + block, side="right")) - 1)
        yield row, stop, data[limits[row] : limits[stop]], limits[row : stop + 1] - limits[row]
        row = stop


def shingled(text: pa.Array) -> Iterator[tuple[int, bytes | None, np.ndarray]]:
    """(row, digest of the word sequence, shingle hashes); fewer words than a shingle make one; none: None."""
    for row, stop, data, limits in rows_in_blocks(text):
        words, rows = word_hashes(data, limits)
        n = max(len(words) - SHINGLE + 1, 0)
        total = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            total += words[j : j + n] * _STEPS[j]
        total = mix(total)
        for i in range(stop - row):
            lo, hi = int(rows[i]), int(rows[i + 1])
            if lo == hi:
                yield row + i, None, total[:0]
                continue
            digest = blake2b(words[lo:hi].tobytes(), digest_size=16).digest()
            if hi - lo >= SHINGLE:
                yield row + i, digest, total[lo : hi - SHINGLE + 1]
            else:
                yield row + i, digest, np.frombuffer(digest[:8], np.uint64)
