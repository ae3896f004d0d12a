"""Elias-Fano sequences in numpy: non-decreasing integers in 2 + log2(universe / n) bits each, searched many at a time."""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th set bit of each byte.
_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _place in enumerate(i for i in range(8) if _byte >> i & 1):
        _SELECT[_byte, _k] = _place


class EliasFano:
    """arrays() are all that queries read; they may be memory-mapped (load)."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        values = values.astype(_U64)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width >> 6) + 2, _U64)
        if width:
            at = np.arange(n, dtype=np.int64) * width
            part = values & _U64((1 << width) - 1)
            shift = (at & 63).astype(_U64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = np.flatnonzero((at & 63) + width > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (_U64(64) - shift[over]))
        high = np.zeros(((n + (max(universe, 1) - 1 >> width) + 1) >> 3) + 2, np.uint8)
        if n:
            at = (values >> _U64(width)).astype(np.int64) + np.arange(n)
            np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        ones = np.concatenate([[0], np.cumsum(_POP[high], dtype=np.int64)])
        self.meta, self.low, self.high, self.ones = np.array([n, width], np.int64), low, high, ones

    def arrays(self) -> list[np.ndarray]:
        return [self.meta, self.low, self.high, self.ones]

    @classmethod
    def load(cls, arrays: list[np.ndarray]) -> EliasFano:
        out = cls.__new__(cls)
        out.meta, out.low, out.high, out.ones = arrays
        return out

    def __len__(self) -> int:
        return int(self.meta[0])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at i."""
        i = np.asarray(i, np.int64)
        byte = np.searchsorted(self.ones, i, "right") - 1
        place = byte * 8 + _SELECT[self.high[byte], i - self.ones[byte]]
        return (place - i).astype(_U64) << _U64(int(self.meta[1])) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        width = int(self.meta[1])
        if not width:
            return np.zeros(len(i), _U64)
        at = i * width
        shift = (at & 63).astype(_U64)
        value = self.low[at >> 6] >> shift
        over = shift > 0
        value[over] |= self.low[(at[over] >> 6) + 1] << (_U64(64) - shift[over])
        return value & _U64((1 << width) - 1)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high parts below bucket: the ones before the bucket-th zero."""
        zeros = np.arange(len(self.ones)) * 8 - self.ones
        byte = np.searchsorted(zeros, bucket, "left") - 1
        byte = np.clip(byte, 0, len(self.high) - 1)
        place = byte * 8 + _SELECT[~self.high[byte], bucket - zeros[byte] - 1]
        return np.where(bucket > 0, place - bucket + 1, 0)

    def successor(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= x, within low and high (exclusive) if given; high or n if there is none."""
        x = x.astype(_U64)
        width = _U64(int(self.meta[1]))
        bucket = np.minimum((x >> width).astype(np.int64), len(self.high) * 8 - len(self))
        a, b = self._before(bucket), self._before(bucket + 1)
        b = np.minimum(b, len(self))
        if low is not None:
            a, b = np.maximum(a, low), np.minimum(b, high)
            a = np.minimum(a, high)
        part = x & _U64((1 << int(width)) - 1)
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = self._lows(mid) < part[todo]
            a[todo[less]] = mid[less] + 1
            b[todo[~less]] = mid[~less]
            todo = todo[a[todo] < b[todo]]
        return a
