"""Sets of word shingles as 64-bit hashes, a whole batch of texts at a time.

Words are runs of other bytes than space and tab to carriage return, A-Z counted as
a-z. A text's set holds a hash for each distinct run of five words; a text with
one to four words has one hash, of all of them; a text without words has none. All
hashes come from one function.
"""

from __future__ import annotations

import functools
from hashlib import blake2b

import numpy as np

WIDTH = 5

# Sums of powers modulo 2^64 have regular collisions between long words (such as those of two letters
# in Thue-Morse order), so words from this length on are hashed one by one.
LONG_WORD = 32

# Bytes hashed at a time; a longer text is hashed by itself.
BYTES_AT_ONCE = 2**20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SHORT = _random.integers(0, 2**64, WIDTH, dtype=np.uint64)
_BASE = int(_random.integers(0, 2**63)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    factors = np.full(n, base % 2**64, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all places."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    made: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) > BYTES_AT_ONCE and waiting:
            made += _sets(waiting)
            waiting, size = [], 0
        waiting.append(text)
        size += len(text) + 1
    return made + _sets(waiting) if waiting else made


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.array([len(t) + 1 for t in texts])
    space = _SPACE[data]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
    room = max(BYTES_AT_ONCE + 1, 1 << int(len(data)).bit_length())
    sums = np.cumsum(np.where(inside, _BYTE[data], np.uint64(0)) * _powers(_BASE, room)[: len(data)])
    sums = np.concatenate((np.zeros(1, np.uint64), sums))
    words = mixed((sums[end] - sums[start]) * _powers(_INVERSE, room)[start])
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        words[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    borders = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    runs = np.zeros(max(0, len(words) - WIDTH + 1), dtype=np.uint64)
    for place in range(WIDTH):
        runs += words[place : place + len(runs)] * _PLACE[place]
    runs = mixed(runs)
    made = []
    for begin, stop in zip(borders[:-1], borders[1:], strict=True):
        n = stop - begin
        if n >= WIDTH:
            made.append(np.unique(runs[begin : stop - WIDTH + 1]))
        elif n:
            whole = (words[begin:stop] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
            made.append(mixed(whole + _SHORT[n : n + 1]))
        else:
            made.append(np.zeros(0, dtype=np.uint64))
    return made
