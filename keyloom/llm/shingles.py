"""Hashed words and shingle sets of whole texts, computed on the bytes of Arrow string columns."""

from __future__ import annotations

import functools

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


@functools.lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    n = 1 << bits
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, _U(base))
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in data) of the words of the texts data[at[i]:at[i+1]], and the first word of each text (len + 1)."""
    lo, hi = int(at[0]), int(at[-1])
    solid = _SOLID[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[at - lo] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first) + lo
    return starts, np.flatnonzero(last) + lo + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, lo: int, hi: int):
    """A function from starts and ends within lo..hi to 64-bit hashes of those bytes, A-Z in lower case."""
    up, down = powers(max(22, int(hi - lo + 1).bit_length()))
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((_FOLD[data[lo:hi]].astype(np.uint64) + _U(1)) * up[: hi - lo], out=sums[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        s, e = starts - lo, ends - lo
        return mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))

    return of


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and the first word of each text (len + 1)."""
    starts, ends, first = words(data, at)
    return span_hashes(data, int(at[0]), int(at[-1]))(starts, ends), first


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, one after another, and where each text's begin (len + 1).

    Shingles are k words; a text of fewer words has one shingle, all its words; one without words has none.
    """
    hashes, first = word_hashes(data, at)
    n_words = np.diff(first)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        rolled = rolled * _U(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
    rolled = mix64(rolled)
    sets = []
    for a, n in zip(first[:-1].tolist(), n_words.tolist()):
        if n >= k:
            s = np.sort(rolled[a : a + n - k + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            h = _U(n)
            with np.errstate(over="ignore"):
                for x in hashes[a : a + n]:
                    h = h * _U(0xA24BAED4963EE407) + x
            sets.append(mix64(np.array([h], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, sets)])
