"""Vectorised word handling on Arrow string buffers (numpy, inside tasks).

A chunk of texts is one byte buffer: words are runs of non-separator bytes,
their 64-bit hashes come from prefix sums of a byte polynomial (no Python loop
over words). Byte level is exact for UTF-8: separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE_LOWER = _BYTE_CODE[LOWER]
# separators: space and 0x09-0x0D only
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# separators: every ASCII byte that is no letter (bytes of other scripts are letters)
NON_LETTERS = np.ones(256, dtype=bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_pow = np.ones(1, dtype=np.uint64)
_ipow = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 1 << 20)
        for_pow, for_inv = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INV, dtype=np.uint64)
        for_pow[0] = for_inv[0] = 1
        _pow, _ipow = np.cumprod(for_pow), np.cumprod(for_inv)
    return _pow, _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one longer text is a range of
    its own), so that temporaries stay small whatever the batch holds."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Hash of each word in order (lower-cased in A-Z unless ``lower`` is off), the
    number of words of each text, and each word's first byte and end.
    ``offsets`` starts at 0 and ends at ``len(data)``."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a word neither starts before nor ends after its text
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data] * power[:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts, starts, ends


_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; a text of
    fewer words has one shingle, its whole sequence, and one without words has
    none."""
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled += hashes[k:len(hashes) - width + 1 + k] * _STEP[k]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(counts.tolist()):
        a = int(first[i])
        if n >= width:
            out.append(np.unique(rolled[a:a + n - width + 1]))
        elif n:
            out.append(mix((hashes[a:a + n] * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + _STEP[15:] * U64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
