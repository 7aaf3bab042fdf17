"""Elias-Fano coding of non-decreasing numbers with sampled select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBI")  # count, largest value, low bits, number of samples
SAMPLE = 256


def encode(values: np.ndarray) -> bytes:
    """Bytes for non-decreasing ``values`` >= 0: about 2 + log2(largest / count) bits per value.

    The low bits of each value are stored as they are; the high bits in unary, value i setting bit
    high + i. The place of every ``SAMPLE``-th set bit is kept, so select reads one short stretch.
    """
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    largest = int(v[-1]) if n else 0
    low = max(0, (max(largest, 1) // max(n, 1)).bit_length() - 1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    bits[ones] = 1
    samples = ones[::SAMPLE].astype("<u4") if n == 0 or ones[-1] < 2**32 else ones[::SAMPLE]
    wide = samples.dtype.itemsize
    shifts = np.arange(low, dtype=np.uint64)
    low_bits = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    head = _HEAD.pack(n, largest, low | (0x80 if wide == 8 else 0), len(samples))
    return head + samples.tobytes() + np.packbits(low_bits, bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()


class EliasFano:
    """Reader of ``encode``'s bytes."""

    def __init__(self, data: bytes):
        self.n, self.largest, low, k = _HEAD.unpack_from(data)
        self.low, wide = low & 0x7F, 8 if low & 0x80 else 4
        at = _HEAD.size
        self.samples = np.frombuffer(data, f"<u{wide}", k, at)
        at += k * wide
        size = (self.n * self.low + 7) // 8
        self._low = np.frombuffer(data, np.uint8, size, at)
        self._high = np.frombuffer(data, np.uint8, len(data) - at - size, at + size)

    def _low_of(self, first: int, last: int) -> np.ndarray:
        """Low bits of values ``first`` to before ``last``."""
        if not self.low:
            return np.zeros(last - first, dtype=np.uint64)
        a, z = first * self.low, last * self.low
        bits = np.unpackbits(self._low[a // 8 : (z + 7) // 8], bitorder="little")[a % 8 : a % 8 + z - a]
        return bits.reshape(-1, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._low_of(0, self.n)

    def select(self, i: int) -> int:
        """Value ``i``, reading from the sampled place before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, rest = divmod(i, SAMPLE)
        start = int(self.samples[k]) // 8
        stop = int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[start:stop], bitorder="little")) + 8 * start
        place = int(ones[int(np.searchsorted(ones, int(self.samples[k]))) + rest])
        return ((place - i) << self.low) | int(self._low_of(i, i + 1)[0])
