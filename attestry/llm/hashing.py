"""Hashes of words and shingles over whole Arrow batches, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; a longer word is hashed alone.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _UNPOW = powers(_BASE, STEP), powers(_UNBASE, STEP)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word, plus the end).

    A word is a run of bytes inside one text for which `space` is false (the default: other than space and
    \\x09-\\x0D); A-Z count as a-z.
    Memory beyond the result is a few times STEP, or the longest word.
    """
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[offsets] = True  # words end where texts end
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + STEP, len(data))
        if to < len(data):  # go back to the last place that no word crosses
            ends = np.flatnonzero(space[data[at:to]] | cuts[at + 1 : to + 1])
            if len(ends):
                to = at + int(ends[-1]) + 1
            else:
                while to < len(data) and not (space[data[to - 1]] or cuts[to]):
                    to += 1
        piece, n = data[at:to], to - at
        solid = ~space[piece]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = True, space[piece[:-1]]
        first = np.flatnonzero(solid & (before | cuts[at:to]))
        if len(first):
            up, down = (_POW, _UNPOW) if n <= STEP else (powers(_BASE, n), powers(_UNBASE, n))
            value = np.where(solid, _BYTE[piece], np.uint64(0)) * up[:n]
            hashes.append(mix(np.add.reduceat(value, first) * down[first]))
            starts.append(first + at)
        at = to
    found = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(found, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text with words is one shingle."""
    hashes, bounds = words(*utf8(column))
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            rolled = rolled + hashes[j : n - k + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            one = np.sort(rolled[lo : hi - k + 1])
            yield one if len(one) < 2 else one[np.concatenate(([True], one[1:] != one[:-1]))]
        elif hi > lo:
            yield mix((hashes[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
        else:
            yield hashes[:0]
