"""Whole batches of texts to 64-bit word hashes and shingle sets, in numpy, byte by byte and without loops over words."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: `[^\x20\x09-\x0D]+`, with A-Z lowered.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits only; every byte of a non-ASCII character counts as a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for k, base in ((0, _MULT), (1, inverse)):
            grown = np.full(n + n // 4, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: np.ndarray = LOWER):
    """(hash of each word, first word of each row + total, byte start of each word, byte end). `offsets` start at 0."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), none, none
    gap = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~gap
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], gap[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((gap[1:], [True])))) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, first: np.ndarray, size: int):
    """(hash of each `size`-word shingle, first shingle of each row + total). Fewer words make one shingle, none make none."""
    n, count = len(hashes), np.diff(first)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    row = np.repeat(np.arange(len(count)), count)
    left = first[row + 1] - np.arange(n)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mix(total + np.where(left > j, padded[j : j + n], np.uint64(0)) + np.uint64(j + 1))
    valid = (left >= size) | (np.arange(n) == first[row])
    at = np.concatenate(([0], np.cumsum(valid)))
    return total[valid], at[first]


def sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the first of each row + total."""
    out, at = [], np.zeros(len(first), np.int64)
    for k in range(len(first) - 1):
        own = np.sort(values[first[k] : first[k + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        at[k + 1] = at[k] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at
