"""Hashed n-gram features of texts, vectorised over a run of texts.

Tokens are runs of letters (with every character beyond ASCII), of digits, and
of other marks; A-Z is lower-cased.  Features are token unigrams and bigrams;
a bigram of two equal tokens is one shared feature, so repetition shows
whatever the word.  Optionally the letter runs give prefixes of some lengths.
"""

from __future__ import annotations

import numpy as np

from .textvec import LOWER, Words, mix, words_of

_U = np.uint64
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[48:58] = 2
_KINDS[65:91] = _KINDS[97:123] = _KINDS[128:] = 1
_TOKEN = _KINDS > 0


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return words_of(LOWER[raw], offsets, is_word=_TOKEN, kinds=_KINDS)


def features(raw: np.ndarray, offsets: np.ndarray, *, bits: int, bigrams: bool = True, prefixes: tuple[int, ...] = (), keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CSR parts over the texts: row pointer, distinct feature ids, counts, tokens a text.

    With ``keep``, a flag per feature id, the others are left out early.
    """
    words = tokens_of(raw, offsets)
    docs = len(offsets) - 1
    ids, rows = [words.hash], [words.doc]
    if bigrams and len(words.hash) > 1:
        same = words.doc[1:] == words.doc[:-1]
        a, b = words.hash[:-1][same], words.hash[1:][same]
        ids.append(np.where(a == b, _U(1), mix(a * _U(0xD6E8FEB86659FD93) + b)))
        rows.append(words.doc[1:][same])
    if prefixes:
        lowered = LOWER[raw]
        for n in prefixes:
            longer = np.flatnonzero((words.end - words.start > n) & (_KINDS[lowered[words.start]] == 1))
            h = np.full(len(longer), n, np.uint64)
            for j in range(n):
                h = h * _U(0x100000001B3) + lowered[words.start[longer] + j]
            ids.append(mix(h))
            rows.append(words.doc[longer])
    row, feature = np.concatenate(rows), np.concatenate(ids) >> _U(64 - bits)
    if keep is not None:
        own = keep[feature.astype(np.int64)]
        row, feature = row[own], feature[own]
    key = (row.astype(np.uint64) << _U(32)) | feature
    key, counts = np.unique(key, return_counts=True)
    row = (key >> _U(32)).astype(np.int64)
    return np.searchsorted(row, np.arange(docs + 1)), (key & _U(0xFFFFFFFF)).astype(np.int64), counts, np.diff(words.first)
