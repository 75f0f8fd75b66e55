"""Vectorised words, word hashes and n-gram hashes over the bytes of many texts.

All of it is numpy over one byte buffer, so a worker spends a few nanoseconds
a byte and no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Other values of the bytes, for a second hash that is independent of the first.
OTHER_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}

#: Byte classes of words that end at ASCII white space only.
SPACE_ENDS = np.ones(256, bool)
SPACE_ENDS[[9, 10, 11, 12, 13, 32]] = False

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = max(n, 1 << 19)
        for key, base in (("p", _P), ("q", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the well-known splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # word index at which each text starts, and the end


def words_of(raw: np.ndarray, offsets: np.ndarray, *, is_word: np.ndarray = SPACE_ENDS, kinds: np.ndarray | None = None) -> Words:
    """Find and hash the words of the texts ``raw[offsets[i]:offsets[i+1]]``.

    ``is_word`` tells which bytes belong to words.  With ``kinds`` (a class per
    byte) a word also ends where the class changes.
    """
    n, docs = len(raw), len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return Words(none, none, none.astype(np.uint64), none, np.zeros(docs + 1, np.int64))
    inside = is_word[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    if kinds is not None:
        kind = kinds[raw]
        before[1:] &= kind[1:] == kind[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    start = np.flatnonzero(inside & ~before)
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = inside[1:] & before[1:]
    end = np.flatnonzero(inside & ~goes_on) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(start, end, hash_spans(raw, start, end), doc, first)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the byte spans raw[start[i]:end[i]], by prefix sums of a polynomial; ``values`` has a number for each byte."""
    p, q = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * p, out=sums[1:])
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of one text, and the index of their first word."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words.hash[:count].copy()
    for j in range(1, n):
        out = out * _U(0xD6E8FEB86659FD93) + words.hash[j : j + count]
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1 : n - 1 + count])
    return mix(out[at]), at
