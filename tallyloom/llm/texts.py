"""Words and hashes of many texts at once, in numpy.

A word is a longest run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D); A-Z count as a-z.
A word's hash is a polynomial over a random value for each byte, mixed; it depends on the word alone, so equal
words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values). space: bytes between words."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~space[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = offsets[offsets < len(data)]
    begins[cuts] = word[cuts]
    starts = np.flatnonzero(begins)
    stops = word[:-1] & ~word[1:]
    inner = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    stops[inner] = word[inner]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A-Z taken as a-z. Starts and ends ascend. Memory is bounded by STEP and the longest span."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        k = max(i + 1, int(np.searchsorted(ends, low + STEP, "right")))
        high = int(ends[k - 1])
        up, down = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=total[1:])
        a, b = starts[i:k] - low, ends[i:k] - low
        out[i:k] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))
        i = k
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the index of its text, from the index of the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of size words, and the index of its first; a shorter text is one shingle, if not empty."""
    counts = np.diff(first)
    n = len(words)
    value = np.zeros(n, U64)
    for k in range(size):
        value[: n - k] = value[: n - k] * U64(0x9FB21C651E98DF25) + words[k:]
    value = mix(value)
    keep = np.zeros(n, bool)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(out)[:-1]]), out) + np.arange(out.sum())
    keep[starts] = True
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        v = U64(len(words[first[i] : first[i + 1]]))
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                v = v * U64(0x9FB21C651E98DF25) + w
        value[first[i]] = mix(np.array([v], U64))[0]
    return value[keep], np.concatenate([[0], np.cumsum(out)])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts and the index of each text's first word."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    starts, ends, first = spans(data, offsets)
    return hash_spans(data, starts, ends), first
