"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def groups(ids, linked):
    """Least id of each id's component under the pairs in ``linked``."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = groups(sets, linked)
    return {i: (len(sets[i]), component[i]) for i in sets}


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i : i + n])].add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def substring_dedup(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k).decode()
        out.append((doc, len(w), len(w) - sum(keep), kept))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
