"""Operator 6, substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one text.  Its minimiser is the
least hash among its runs of ``seed`` words; equal windows have equal
minimisers.  Consecutive windows with the same minimiser form a super-k-mer
and travel together as one packed string to the minimiser's bucket, where
sorting the windows shows which start more than once.  A word is removed when
any window over it starts anywhere else too, in the same text or another.

Steps, and what each moves:

1. Count the super-k-mers of every minimiser (8-byte keys, summed before the
   shuffle).  A window can only repeat when its minimiser does.
2. A Bloom filter of the repeated minimisers (``bloom_bits`` at most, built by
   a grouped bit_or) goes to all tasks.  False hits only cost traffic.
3. Super-k-mers of repeated minimisers are packed and shuffled.  A minimiser
   of ``hot_least`` super-k-mers or more is *hot*, whatever the corpus: a passage
   or text with very many copies.  A bucket of strings so has a fixed bound.
   The hot ones are told by a second Bloom filter; what it holds falsely is
   counted right as well.  Its windows do not travel as strings to one
   bucket.  Each task first counts them itself; those it holds twice are
   settled there, and every different one goes once, as a 128-bit fingerprint,
   to a bucket chosen by that fingerprint.  So a bucket gets a window at most
   once from a task, and no text or passage fills a bucket.
4. The removed spans go back to their texts by (doc_id, hash of the text).

Defined results.  Null and empty texts, and those below ``window`` words, lose
nothing.  Rows are kept one to one; repeated rows are copies of each other and
so lose all words (from ``window`` words on).  A null doc_id is a key like any
other.  Words end at space, tab, line feed, vertical tab, form feed and
carriage return, and are compared as they are.  Only the named columns are
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, plain_text, written
from .textvec import OTHER_BYTES, Words, hash_spans, mix, words_of

_U = np.uint64
SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_SPANS_SQL = "array<struct<from:long,to:long>>"
#: A super-k-mer is cut after so many windows (only texts that repeat a phrase over and over get there).
MAX_RUN = 256
#: Hot windows that a task gathers before it sends them.
FLUSH = 1 << 19


class SuperKmers:
    """Super-k-mers of a run of texts: window ranges [first, last] by word index, and minimisers."""

    def __init__(self, column: pa.Array, lo: int, hi: int, window: int, seed: int):
        texts = [b" ".join(t.as_py().encode("utf-8", "surrogatepass").split()) for t in column[lo:hi]]
        self.data = b"\n".join(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        offsets[-1] -= 1
        raw = np.frombuffer(self.data, np.uint8)
        self.words: Words = words_of(raw, offsets)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.doc = none
        self.minimiser, self.twice = none.astype(np.uint64), none.astype(bool)
        n = len(self.words.hash)
        windows, span = n - window + 1, window - seed + 1
        if windows <= 0:
            return
        grams = self.words.hash[: n - seed + 1].copy()
        for j in range(1, seed):
            grams = grams * _U(0xD6E8FEB86659FD93) + self.words.hash[j : n - seed + 1 + j]
        grams = mix(grams)
        least, reach = grams, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: windows], least[span - reach : span - reach + windows])
        doc = self.words.doc
        valid = doc[:windows] == doc[window - 1 : window - 1 + windows]
        starts = valid.copy()
        starts[1:] &= ~(valid[:-1] & (least[1:windows] == least[: windows - 1]))
        begin = np.flatnonzero(starts)
        if not len(begin):
            return
        at = np.flatnonzero(valid)
        run = np.cumsum(starts)[at] - 1
        place = at - begin[run]
        cut = at[place % MAX_RUN == 0]
        self.first = cut
        bound = np.searchsorted(at, cut)
        self.last = at[np.concatenate([bound[1:], [len(at)]]) - 1]
        self.minimiser = least[cut]
        self.doc = doc[cut]
        lengths = self.last - self.first + span
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(self.first - (ends - lengths), lengths)
        hits = grams[index] == np.repeat(self.minimiser, lengths)
        self.twice = np.add.reduceat(hits, ends - lengths, dtype=np.int64) > 1

    def packed(self, i: int, window: int) -> bytes:
        return self.data[self.words.start[self.first[i]] : self.words.end[self.last[i] + window - 1]]


def _count(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in byte_slices(b.column(0)):
                s = SuperKmers(b.column(0), lo, hi, window, seed)
                keys, inverse = np.unique(s.minimiser, return_inverse=True)
                n = np.bincount(inverse, 1 + s.twice, minlength=len(keys)) if len(keys) else np.zeros(0)
                yield pa.RecordBatch.from_pydict({"minimiser": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def _in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = _U(len(bits) * 64 - 1)
    out = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> _U(32)) & mask):
        out &= (bits[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == 1
    return out


_SENT = f"kind byte, key long, doc_id long, text_hash long, first long, packed binary, fp binary, refs binary, spans {_SPANS_SQL}"


def _merged(starts: np.ndarray, window: int) -> list[dict[str, int]]:
    """Word spans of the sorted window starts, touching ones merged."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    low = starts[np.concatenate([[0], cut])]
    high = starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window
    return [{"from": int(a), "to": int(b)} for a, b in zip(low, high)]


def _by_text(doc_id: np.ndarray, text_hash: np.ndarray, start: np.ndarray, window: int):
    """(doc_id, text_hash, spans) of each text among parallel arrays of window starts."""
    order = np.lexsort((start, text_hash, doc_id))
    doc_id, text_hash, start = doc_id[order], text_hash[order], start[order]
    cut = np.flatnonzero((np.diff(doc_id) != 0) | (np.diff(text_hash) != 0)) + 1
    for own in np.split(np.arange(len(start)), cut):
        if len(own):
            yield int(doc_id[own[0]]), int(text_hash[own[0]]), _merged(np.unique(start[own]), window)


def _twins(fp: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the (n, 2) fingerprints, and in that order the total weight of each one's group."""
    order = np.lexsort((fp[:, 1], fp[:, 0]))
    f = fp[order]
    new = np.concatenate([[True], (np.diff(f[:, 0]) != 0) | (np.diff(f[:, 1]) != 0)])
    group = np.cumsum(new) - 1
    return order, np.bincount(group, weight[order]).astype(np.int64)[group]


def _row(**values) -> dict:
    return {k: values.get(k) for k in ("kind", "key", "doc_id", "text_hash", "first", "packed", "fp", "refs", "spans")}


_ARROW = pa.schema(
    [("kind", pa.int8()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("packed", pa.binary()), ("fp", pa.binary()), ("refs", pa.binary()), ("spans", SPANS)]
)
#: Kinds of sent rows: a packed super-k-mer; fingerprints of hot windows; spans already settled.
PACKED, HOT, SETTLED = 0, 1, 2


def _send(window: int, seed: int, bits: np.ndarray, hot: np.ndarray, buckets: int):
    """Rows of (doc_id or a stand-in for null, text_hash, text) to packed super-k-mers, hot fingerprints and settled spans."""

    def flush(gathered: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not gathered:
            return
        fp, doc_id, text_hash, start = (np.concatenate(x) for x in zip(*gathered))
        gathered.clear()
        order, n = _twins(fp, np.ones(len(fp)))
        fp, doc_id, text_hash, start = fp[order], doc_id[order], text_hash[order], start[order]
        again = n > 1
        rows = [_row(kind=SETTLED, doc_id=d, text_hash=h, spans=s) for d, h, s in _by_text(doc_id[again], text_hash[again], start[again], window)]
        lead = np.concatenate([[True], (np.diff(fp[:, 0]) != 0) | (np.diff(fp[:, 1]) != 0)])
        fp, refs = fp[lead], np.stack([doc_id, text_hash, start, np.minimum(n, 2)], 1)[lead]
        bucket = (fp[:, 0] % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for own in np.split(order, cuts):
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                rows.append(_row(kind=HOT, key=int(bucket[part[0]]), fp=fp[part].tobytes(), refs=refs[part].tobytes()))
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, _, _ in byte_slices(b.column(2)):
                s = SuperKmers(b.column(2), lo, hi, window, seed)
                is_hot = _in_bloom(hot, s.minimiser)
                base = s.words.first
                out = []
                for i in np.flatnonzero(~is_hot & _in_bloom(bits, s.minimiser)):
                    d = s.doc[i]
                    out.append(_row(kind=PACKED, key=int(s.minimiser[i].view(np.int64)), doc_id=int(ids[lo + d]), text_hash=int(hashes[lo + d]), first=int(s.first[i] - base[d]), packed=s.packed(i, window)))
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                if is_hot.any():
                    lengths = (s.last - s.first + 1)[is_hot]
                    ends = np.cumsum(lengths)
                    at = np.arange(ends[-1]) + np.repeat(s.first[is_hot] - (ends - lengths), lengths)
                    d = s.words.doc[at]
                    gathered.append((_fingerprints(s, at, window), ids[lo + d], hashes[lo + d], at - base[d]))
                    waiting += len(at)
                    if waiting >= FLUSH:
                        yield from flush(gathered)
                        waiting = 0
        yield from flush(gathered)

    return run


def _fingerprints(s: SuperKmers, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits for each window start in ``at``: two polynomials over two independent hashes of its words."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    other = hash_spans(np.frombuffer(s.data, np.uint8), s.words.start, s.words.end, OTHER_BYTES)
    for j in range(window):
        a = a * _U(0xD6E8FEB86659FD93) + s.words.hash[at + j]
        b = b * _U(0xC2B2AE3D27D4EB4F) + other[at + j]
    return np.stack([mix(a), mix(b)], 1)


def _settle_packed(window: int):
    """Rows (key, doc_id, text_hash, first, packed) sorted by key to (doc_id, text_hash, spans)."""

    def settle(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, list[dict[str, int]]]]:
        by_string: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        for doc_id, text_hash, first, packed in rows:
            by_string[packed].append((doc_id, text_hash, first))
        windows: list[tuple[bytes, int, int]] = []
        strings = list(by_string)
        for k, packed in enumerate(strings):
            starts, at = [0], packed.find(b" ")
            while at >= 0:
                starts.append(at + 1)
                at = packed.find(b" ", at + 1)
            ends = [*(x - 1 for x in starts[1:]), len(packed)]
            windows += [(packed[starts[i] : ends[i + window - 1]], k, i) for i in range(len(starts) - window + 1)]
        windows.sort()
        again: dict[int, list[int]] = defaultdict(list)
        i = 0
        while i < len(windows):
            j = i + 1
            while j < len(windows) and windows[j][0] == windows[i][0]:
                j += 1
            if j - i > 1 or len(by_string[strings[windows[i][1]]]) > 1:
                for _, k, at in windows[i:j]:
                    again[k].append(at)
            i = j
        for k, starts in again.items():
            spans = np.array(sorted(starts), np.int64)
            for doc_id, text_hash, first in by_string[strings[k]]:
                yield doc_id, text_hash, _merged(spans + first, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if k != key:
                    found += settle(rows)
                    key, rows = k, []
                    if len(found) > 4096:
                        yield _spans_batch(found)
                        found = []
                rows.append(row)
        found += settle(rows)
        yield _spans_batch(found)

    return run


def _settle_hot(window: int):
    """Rows (key, fp, refs) sorted by key to (doc_id, text_hash, spans)."""

    def settle(parts: list[tuple[bytes, bytes]]) -> list[tuple[int, int, list[dict[str, int]]]]:
        if not parts:
            return []
        fp = np.frombuffer(b"".join(p[0] for p in parts), np.uint64).reshape(-1, 2)
        refs = np.frombuffer(b"".join(p[1] for p in parts), np.int64).reshape(-1, 4)
        order, n = _twins(fp, refs[:, 3])
        refs = refs[order]
        ask = (n > 1) & (refs[:, 3] == 1)  # what its own task held twice is settled there
        return list(_by_text(refs[ask, 0], refs[ask, 1], refs[ask, 2], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in batches:
            for k, *part in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key:
                    yield _spans_batch(settle(parts))
                    key, parts = k, []
                parts.append(part)
        yield _spans_batch(settle(parts))

    return run


def _spans_batch(found: list[tuple[int, int, list[dict[str, int]]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array([x[0] for x in found], pa.int64()), "text_hash": pa.array([x[1] for x in found], pa.int64()), "spans": pa.array([x[2] for x in found], SPANS)}
    )


_NULL_ID = -(1 << 63)


def _bloom(minimisers: DataFrame, n: int, most: int) -> np.ndarray:
    """A Bloom filter of the ``n`` keys as 64-bit words, of at most ``most`` bits; set by a grouped bit_or."""
    size = 64
    while size < min(most, 16 * n):
        size *= 2
    p = F.explode(F.array(F.col("minimiser").bitwiseAND(size - 1), F.shiftrightunsigned("minimiser", 32).bitwiseAND(size - 1)))
    words = minimisers.select(p.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def repeated_spans(docs: DataFrame, *, window: int = 35, seed: int = 8, bloom_bits: int = 1 << 25, hot_least: int = 1024) -> DataFrame:
    """doc_id (a stand-in for null), text_hash, spans array<struct<from,to>> of words to remove; for texts with any."""
    spark = docs.sparkSession
    texts = _keyed(docs)
    counts = written(texts.select("text").mapInArrow(_count(window, seed), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1"), "minimisers")
    is_hot = F.col("n") >= hot_least
    n_repeated, n_hot, hot_runs = counts.agg(F.count("*"), F.count_if(is_hot), F.coalesce(F.sum(F.when(is_hot, F.col("n"))), F.lit(0))).first()
    bits, hot = _bloom(counts, n_repeated, bloom_bits), _bloom(counts.where(is_hot), n_hot, bloom_bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, hot_runs * (window - seed + 1) // (1 << 18))
    sent = written(texts.mapInArrow(_send(window, seed, bits, hot, buckets), _SENT), "super-kmers")
    schema = f"doc_id long, text_hash long, spans {_SPANS_SQL}"
    packed = sent.where(F.col("kind") == PACKED).select("key", "doc_id", "text_hash", "first", "packed")
    found = packed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_settle_packed(window), schema)
    settled = sent.where(F.col("kind") == SETTLED).select("doc_id", "text_hash", "spans")
    found = found.unionByName(settled)
    if n_hot:
        prints = sent.where(F.col("kind") == HOT).select("key", "fp", "refs")
        found = found.unionByName(prints.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_settle_hot(window), schema))
    return found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # a set: rows that repeat an id and text bring the same spans


def _keyed(docs: DataFrame) -> DataFrame:
    return plain_text(docs).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _cut() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist()):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if spans:
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["from"] : s["to"]] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) of every row."""
    spans = repeated_spans(docs, **options)
    joined = _keyed(docs).join(spans, ["doc_id", "text_hash"], "left")
    row = F.nullif("doc_id", F.lit(_NULL_ID))
    return (
        joined.select(F.struct(row.alias("doc_id")).alias("row"), "text", "spans")
        .mapInArrow(_cut(), "row struct<doc_id:long>, n_words long, n_removed long, kept_text string")
        .select("row.doc_id", "n_words", "n_removed", "kept_text")
    )


