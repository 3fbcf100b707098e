"""Vectorised word hashing over the raw bytes of many texts at once.

A word's 64-bit hash is a polynomial over a random byte table, taken as a
difference of prefix sums, so that no Python code runs per word or per byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What separates words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Also ASCII punctuation separates; letters, digits and bytes of other scripts make words.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = np.full(size, _BASE, np.uint64)
    up[0] = 1
    down = np.full(size, inverse, np.uint64)
    down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the text's number it is in; words never cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    opens[cut] = inside[cut]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (lower-cased) byte runs."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text numbers, starts and ends of all words, A to Z lower-cased."""
    low = LOWER[data]
    starts, ends, doc = spans(low, offsets, separator)
    return hashes(low, starts, ends), doc, starts, ends


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, over text borders too: the caller drops those."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            total = total * _STEP + word[k : len(word) - n + 1 + k]
    return mix(total)


def counts_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)
