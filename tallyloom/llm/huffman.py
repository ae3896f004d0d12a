"""Canonical length-limited Huffman codes of token ids, and blocks of them that are decoded by table from checkpoints.

A block's bits are decoded in lanes: every STEP-th id's bit offset is kept, and all lanes read one id at a time together, each by one look-up of its next
bits in a table of 2^limit entries.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code; more where there are more ids than it has codes for. Ids between two checkpoints.
LIMIT, STEP = 18, 128


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths (0: no code) that give the fewest bits in all with no code longer than limit, by package-merge.

    Of ids that occur equally often the larger ones count as the rarer, so lengths depend on counts alone. A single id gets one bit.
    """
    ids = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids have no codes of {limit} bits")
    ids = ids[np.lexsort((-ids, counts[ids]))]
    weight = counts[ids].astype(np.int64)
    # level by level: leaves and packages (sums of two neighbours of the level before), by weight, leaves first
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(ids) - 2, np.zeros(len(ids) + 1, np.int64)
    for is_leaf in reversed(levels):  # the first take items of a level: its rarest leaves, and packages of twice as many items below
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    out[ids] = np.cumsum(depth)[:-1]
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """Canonical codes: by length and then id, each the one before plus one, shifted to its length."""
    out = np.zeros(len(length), np.uint32)
    ids = np.nonzero(length)[0]
    if not len(ids):
        return out
    ids = ids[np.lexsort((ids, length[ids]))]
    size = length[ids].astype(np.int64)
    # in units of the longest code, a code takes 2^(longest - its length) places
    places = np.int64(1) << (size.max() - size)
    out[ids] = (np.cumsum(places) - places) >> (size.max() - size)
    return out


class Coder:
    def __init__(self, length: np.ndarray):
        self.length, self.code = length.astype(np.int64), codes(length).astype(np.int64)
        self.bits = int(length.max(initial=1))
        if self.bits > 25:
            raise ValueError("a code must fit a window of 32 bits from any bit of a byte")

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids and the bits between checkpoints, the first of which is at 0."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = ends - size
        total = int(ends[-1]) if len(ids) else 0
        window = self.code[ids] << (32 - (at & 7) - size)
        out, byte = np.zeros((total + 7) // 8 + 4), at >> 3
        for k in range(4):  # codes have no bit in common, so sums are unions
            out += np.bincount(byte + k, (window >> (24 - 8 * k)) & 0xFF, minlength=len(out))
        return out[: (total + 7) // 8].astype(np.uint8).tobytes(), np.diff(at[::STEP], prepend=0).astype(np.uint32)

    def table(self) -> np.ndarray:
        """For each value of the next bits: id * 32 + length of the code that they begin with; negative where they are no code."""
        if not hasattr(self, "_table"):
            ids = np.nonzero(self.length)[0]
            ids = ids[np.argsort(self.code[ids] << (self.bits - self.length[ids]))]
            full = np.repeat(ids << 5 | self.length[ids], 1 << (self.bits - self.length[ids]))
            self._table = np.concatenate([full, np.full((1 << self.bits) - len(full), -31)]).astype(np.int32)
        return self._table

    def decode(self, data: bytes, gaps: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; raises ValueError where the bits are no codes."""
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        raw = np.concatenate([raw, np.zeros(8, np.uint32)])
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        table, drop = self.table(), np.uint32(32 - self.bits)
        at, lanes = np.cumsum(gaps.astype(np.int64)), len(gaps)
        out = np.zeros((STEP, lanes), np.int32)
        for k in range(min(STEP, n)):
            live = (n - k + STEP - 1) // STEP  # lanes that have a k-th id: all but the last, perhaps
            pos = at[:live]
            bits = window.take(pos >> 3, mode="clip") << (pos & 7).astype(np.uint32)
            found = table.take(bits >> drop)
            out[k, :live] = found
            pos += found & 31
        out = out.T.ravel()[:n]
        if n and out.min() < 0:
            raise ValueError("bits that are no code")
        return (out >> 5).astype(np.int64)
