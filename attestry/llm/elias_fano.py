"""Elias-Fano coding of non-decreasing integers, with select by samples.

n values below u keep their l = floor(log2(u / n)) low bits in a packed array; the high parts are a bit
vector in which the i-th one stands at high(i) + i. Together at most 2 + log2(u / n) bits a value. Every
SAMPLE-th one's position is stored in 32 bits; select(i) starts there and counts ones byte by byte.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBQ")  # n, number of high bits, l, number of samples
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def pack(values: np.ndarray) -> bytes:
    """values: non-decreasing integers >= 0."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) + 1 if n else 1
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = v & np.uint64((1 << low_bits) - 1)
    places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    size = int(places[-1]) + 1 if n else 0
    high = np.zeros(size, np.uint8)
    high[places] = 1
    bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    samples = places[::SAMPLE].astype("<u4")
    return b"".join([_HEAD.pack(n, size, low_bits, len(samples)), samples.tobytes(), np.packbits(high, bitorder="little").tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes()])


class Sequence:
    """Reads what pack() wrote."""

    def __init__(self, data: bytes):
        self.n, self.size, self.low_bits, samples = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.samples = np.frombuffer(data, "<u4", samples, at)
        self.high = np.frombuffer(data, np.uint8, -(-self.size // 8), at + 4 * samples)
        self.low = np.frombuffer(data, np.uint8, offset=at + 4 * samples + len(self.high))

    def __len__(self) -> int:
        return self.n

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.uint64)
        for b in range(self.low_bits):
            bit = index * self.low_bits + b
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        # ones of the sample's byte before the sample don't count
        left += int(_ONES[self.high[byte] & ((1 << (place & 7)) - 1)])
        while left >= _ONES[self.high[byte]]:
            left -= int(_ONES[self.high[byte]])
            byte += 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        place = byte * 8 + int(bits[left])
        return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All values, by one pass over the high bits."""
        places = np.flatnonzero(np.unpackbits(self.high, count=self.size, bitorder="little"))
        i = np.arange(self.n)
        return ((places - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)
