"""Operator 3, benchmark decontamination by a generalised suffix automaton.

The normalised words of all benchmark items form one suffix automaton.  Every
text streams through it once, word by word; the automaton's state and the
length of the longest match are all that is carried.  A match of ``window``
words or more marks the last ``window`` words; an item shorter than that is a
window of its own.  The state tells which items hold the matched window.

Scale.  The texts are never shuffled: one pass of ``mapInArrow``.  The
automaton is broadcast, and its size is bounded: a word takes about a kilobyte
in the driver and in every worker, and items beyond ``max_words`` words are dealt to further automata, each of which gets its own
pass that adds to the spans found before, so a benchmark of any size is
matched exactly.

Normalising: A-Z is lower-cased; a word is a run of ``0-9``, ``a-z`` and
characters beyond ASCII.

Defined results.  Null or empty texts have no words.  Items with null or empty
text have no window; items with a null id are ignored; two items with the same
text are both named.  Rows are kept one to one, repeated doc_ids too.  With an
empty benchmark nothing is hit.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_in, whole_rows, with_text, written
from .labelled import by_id

#: Bytes that end words become spaces, A-Z becomes a-z.
_NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class SuffixAutomaton:
    """A generalised suffix automaton over words, with the items of every state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str, list[int]]] = []
        for item, words in items:
            if words:
                state, path = 0, []
                for w in words:
                    state = self._extend(state, w)
                    path.append(state)
                ends.append((item, words))
        self.names = sorted({item for item, _ in ends})
        number = {name: i for i, name in enumerate(self.names)}
        held: list[set[int]] = [set() for _ in self.next]
        shorts: dict[int, list[tuple[int, int]]] = {}
        for item, words in ends:
            k, state = number[item], 0
            for w in words:
                state = self.next[state][w]
                up = state
                while up > 0 and k not in held[up]:
                    held[up].add(k)
                    up = self.link[up]
            if len(words) < window:
                shorts.setdefault(state, []).append((len(words), k))
        #: For a state that holds matches of window words: the items with the last window words.
        self.items: list[frozenset[int] | None] = [None] * len(self.next)
        #: Short items that end wherever the state does, as (words, item).
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.shorts[s] = tuple(shorts.get(s, ())) + self.shorts[up]
            if self.length[s] >= window:
                self.items[s] = frozenset(held[s]) if self.length[up] < window else self.items[up]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint, sorted word spans [from, to) inside windows, and the items found."""
        nxt, link, length, window, items, shorts = self.next, self.link, self.length, self.window, self.items, self.shorts
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        root = nxt[0]
        state = size = at = 0
        for w in words:
            at += 1
            if not state:
                state = root.get(w, 0)
                if not state:
                    continue
                size = 1
            else:
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    size = 0
                    continue
                state = to
                size += 1
            reach = 0
            if size >= window:
                reach = window
                found |= items[state]
            if shorts[state]:
                for n, k in shorts[state]:
                    if n <= size:
                        found.add(k)
                        reach = max(reach, n)
            if reach:
                low = at - reach
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, at))
        return spans, found


_SPANS = "spans array<struct<from:long,to:long>>, items array<string>"


def scan_texts(rows: DataFrame, benchmark: DataFrame, *, window: int = 10, max_words: int = 200_000, clean: bool = False) -> DataFrame:
    """For ``rows`` of (row, text), or of (row) with the text in it: row, n_words, n_hit, spans of words, items (sorted ids), and with ``clean`` clean_text.

    ``row`` is any struct that travels along, so callers keep their columns
    without a join.  ``clean_text`` is the text without the hit words, each
    span from the first character of its first word to the last of its last.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    groups = max(1, -(-words // max_words))
    row = "row " + rows.schema["row"].dataType.simpleString()
    text = "text string, " if "text" in rows.columns else ""
    out = rows
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        automaton = SuffixAutomaton([(r["item"], normal_words(r["text"])) for r in part.collect()], window)
        if g < groups - 1:
            out = written(out.mapInArrow(_scanner(automaton, False, False), f"{row}, {text}{_SPANS}"), "decontaminate")
    head = f"{row}, clean_text string" if clean else row
    return out.mapInArrow(_scanner(automaton, True, clean), f"{head}, n_words long, n_hit long, {_SPANS}")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, done = [], 0
    for low, high in spans:
        parts.append(text[done : at[low][0]])
        done = at[high - 1][1]
    return "".join([*parts, text[done:]])


def _scanner(automaton: SuffixAutomaton, last: bool, clean: bool):
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = "spans" in batch.schema.names
            old_spans, old_items = (batch.column(k).to_pylist() if again else [None] * batch.num_rows for k in ("spans", "items"))
            texts = texts_in(batch.drop_columns(["spans", "items"]) if again else batch)
            n_words, n_hit, spans, items, cleaned = [], [], [], [], []
            for value, olds, oldi in zip(texts, old_spans, old_items):
                text = value.as_py()
                words = normal_words(text)
                here, found = automaton.scan(words)
                names = {automaton.names[k] for k in found}.union(oldi or ())
                if olds:
                    here = _merge([*here, *((s["from"], s["to"]) for s in olds)])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in here))
                spans.append([{"from": a, "to": b} for a, b in here])
                items.append(sorted(names))
                if clean:
                    cleaned.append(_without(text, here))
            out = {"row": batch.column(0)}
            if clean:
                out["clean_text"] = pa.array(cleaned, pa.string())
            if last:
                out |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            elif "text" in batch.schema.names:
                out["text"] = texts
            yield pa.RecordBatch.from_pydict(out | {"spans": pa.array(spans, pa.list_(span)), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items of every document."""
    found = scan_texts(by_id(docs), benchmark, **options)
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with the hit spans cut from the texts; a text hit over more than ``max_coverage`` of its words goes.

    The columns of ``docs`` are kept; ``n_chars``, where there is one, follows the text.
    """
    found = scan_texts(whole_rows(docs), benchmark, window=window, clean=True).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return found.select(*with_text(docs, "row", F.col("n_hit") > 0, F.col("clean_text")))
