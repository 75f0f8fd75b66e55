"""Operator 2, best-fit packing after a Martello-Toth dominance reduction.

Texts become token ids plus an end id; texts of more than ``capacity`` ids are
cut into pieces of that length.  Lengths are whole numbers up to the capacity,
so the whole instance is its histogram: one count per length, at most
``capacity`` rows whatever the corpus.  The histogram is packed exactly as the
pieces would be, with multiplicities:

1. Reduction.  For the largest remaining length, the set {it, its largest
   fitting partner} is fixed for as many copies as there are whenever it
   dominates every other feasible set: nothing fits beside it; or the partner
   fills the bin; or every feasible further set has two items at most and none
   weighs more than the partner.
2. Best fit, longest first, on the rest.  Bins are runs of equal bins, keyed by
   the room left in them.

The result is a plan of runs: the pieces of one length with ranks from
``rank`` on go, ``per_bin`` to a bin, into the bins from ``bin`` on, at
``offset``.  Each piece then looks up its own place.  Its rank among the
pieces of its length is (pieces of that length in lower partitions) plus (its
place in its own partition), so no partition ever gathers a length.

Scale.  Shuffled are only counts per (partition, length) and the pieces'
fixed-width rows, never texts or ids.  The driver holds the histogram and the
plan; ``max_plan`` runs is checked before the plan is broadcast, beyond it the
plan is joined as a table.

Defined results.  Null and empty texts are the end id alone.  Every row of the
input is packed, repeated and null doc_ids too.  An empty table has no pieces.
Only the named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, plain_text, written
from .textvec import LOWER, hash_spans, words_of

#: Strings a worker's cache holds at most, and how many new ones it takes before they are sorted in; some 30 bytes each.
CACHE_WORDS, CACHE_YOUNG = 700_000, 40_000
_U = np.uint64
#: Bytes of a-z and of the Latin-1 letters in UTF-8, whose lead byte is C3; C3 97 and C3 B7 are no letters.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:192] = _LETTER[0xC3] = True
_MARKS = np.zeros(256, np.uint64)
_MARKS[ord(".")], _MARKS[ord(",")] = 1, 2


class WordCachedTokenizer:
    """Ids of whole texts, as the tokenizer gives them, from a bounded cache per string between white space.

    Exact for tokenizers that lower-case, whose pre-tokens never reach across
    white space, which they drop, and whose words end in an id marked
    ``</w>``.  A string of plain letters before one ``.`` or ``,`` is looked
    up by its letters.  Strings are told apart by 62-bit hashes, found for a
    run of texts at once; letters not seen before are encoded many at a time
    and told apart by the marked ids, other strings one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.no_truncation()
        vocabulary = self._own.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._young: dict[int, bytes] = {}
        self._keys, self._place, self._size, self._flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self._marks = [b"", *self._encode([".", ","])]

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._own.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            cuts = (np.flatnonzero(self._ends[np.frombuffer(ids, "<u4")]) + 1).tolist()
            if len(cuts) == len(group):
                out += [ids[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self._encode(group)
        return out

    def _settled(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the sorted part of the cache holds, and where."""
        at = np.minimum(np.searchsorted(self._keys, keys), max(0, len(self._keys) - 1))
        return (self._keys[at] == keys if len(self._keys) else np.zeros(len(keys), bool)), at

    def _settle(self) -> None:
        """Sort the young strings in; a full cache starts again from them."""
        keys = np.fromiter(self._young, np.uint64, len(self._young))
        sizes = np.fromiter((len(v) // 4 for v in self._young.values()), np.int64, len(self._young))
        flat = np.frombuffer(b"".join(self._young.values()), "<u4")
        place = np.cumsum(sizes) - sizes
        if len(self._keys) + len(keys) <= CACHE_WORDS:
            keys, place, sizes, flat = (np.concatenate(x) for x in ((self._keys, keys), (self._place, place + len(self._flat)), (self._size, sizes), (self._flat, flat)))
        order = np.argsort(keys)
        self._keys, self._place, self._size, self._flat = keys[order], place[order], sizes[order], flat
        self._young = {}

    def _learn(self, missing: list[tuple[int, int]], string, plain: list[bool]) -> None:
        """Put the values of (key, number) pairs into the young part; ``string(i)`` is the text of number i."""
        young = self._young
        letters: dict[int, str] = {}
        other: dict[int, str] = {}
        for key, i in missing:
            if not plain[i]:
                other[key] = string(i)
            elif key & ~3 not in young:
                letters[key & ~3] = string(i)
        bare = np.fromiter(letters, np.uint64, len(letters))
        held, at = self._settled(bare)
        for key, k in zip(bare[held].tolist(), at[held].tolist()):
            young[key] = self._flat[self._place[k] : self._place[k] + self._size[k]].tobytes()
            del letters[key]
        young |= zip(letters, self._encode_letters(list(letters.values())))
        young |= zip(other, self._encode(list(other.values())))
        for key, _ in missing:
            if key not in young:
                young[key] = young[key & ~3] + self._marks[key & 3]

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of the run ``raw[offsets[i]:offsets[i + 1]]``."""
        low = LOWER[raw]
        words = words_of(low, offsets)
        start, end = words.start, words.end
        if not len(start):
            return [np.zeros(0, "<u4")] * (len(offsets) - 1)
        odd = ~_LETTER[low]
        lead = np.flatnonzero(low == 0xC3)
        odd[lead[np.isin(low[np.minimum(lead + 1, len(low) - 1)], (0x97, 0xB7))]] = True
        odds = np.concatenate([[0], np.cumsum(odd)])
        mark = _MARKS[low[end - 1]] * (end - start > 1)
        bare = end - (mark > 0)
        plain = odds[bare] == odds[start]
        bare, mark = np.where(plain, bare, end), np.where(plain, mark, _U(0))
        key, at, inverse = np.unique(hash_spans(low, start, bare) & ~_U(3) | mark | _U(3) * ~plain, return_index=True, return_inverse=True)
        if len(self._young) > CACHE_YOUNG:
            self._settle()
        held, where = self._settled(key)
        fresh = np.flatnonzero(~held)
        keys = key[fresh].tolist()
        missing = [(k, i) for i, k in enumerate(keys) if k not in self._young]
        if missing:
            data, first = low.tobytes(), at[fresh]
            begin, stop = start[first].tolist(), bare[first].tolist()
            self._learn(missing, lambda i: data[begin[i] : stop[i]].decode("utf-8", "replace"), plain[first].tolist())
        values = [self._young[k] for k in keys]
        own = np.frombuffer(b"".join(values), "<u4")
        sizes, place = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        sizes[held], place[held] = self._size[where[held]], self._place[where[held]]
        sizes[fresh] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        place[fresh] = np.cumsum(sizes[fresh]) - sizes[fresh]
        n = sizes[inverse]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(place[inverse] - (ends - n), n)
        old = np.repeat(held[inverse], n)
        out = np.empty(len(index), "<u4")
        out[old], out[~old] = self._flat[index[old]], own[index[~old]]
        bounds = np.concatenate([[0], ends])[words.first]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer for each Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCachedTokenizer(path)


def _pieces(path: str, capacity: int, end_id: int, with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, encoder = np.array([end_id], "<u4"), tokenizer(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in byte_slices(batch.column(1)):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank")}
                tokens = []
                for doc, ids in zip(docs[lo:hi], encoder.ids(raw, offsets)):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        size = len(own)
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(at)
                        out["length"].append(size)
                        out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        out["rank"].append(seen[size])
                        seen[size] += 1
                        if with_tokens:
                            tokens.append(own.astype(np.int32))
                columns = {k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()}
                columns["task"] = pa.array([task] * len(out["rank"]), pa.int32())
                if with_tokens:
                    columns["tokens"] = pa.array(tokens, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks in [rank, rank + count) go ``per_bin`` to a bin, from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    per_bin: int
    bin: int
    offset: int


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Fixed sets as (length, partner or 0, copies), and the counts that remain."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    fixed: list[tuple[int, int, int]] = []
    for big in sorted(left, reverse=True):
        while left.get(big):
            room = capacity - big
            partner = _largest(sizes, left, room, big)
            if partner is None:
                copies = left[big]
                fixed.append((big, 0, copies))
            elif partner == room or _dominates(sizes, left, big, partner, room):
                copies = left[big] // 2 if partner == big else min(left[big], left[partner])
                fixed.append((big, partner, copies))
                left[partner] -= copies
            else:
                break
            left[big] -= copies
        sizes = [n for n in sizes if left.get(n)]
    return fixed, {n: c for n, c in left.items() if c}


def _largest(sizes: list[int], left: dict[int, int], room: int, big: int) -> int | None:
    """The largest remaining length that fits in ``room`` beside one piece of length ``big``."""
    i = bisect_left(sizes, room + 1) - 1
    while i >= 0:
        if left[sizes[i]] - (sizes[i] == big) > 0:
            return sizes[i]
        i -= 1
    return None


def _dominates(sizes: list[int], left: dict[int, int], big: int, partner: int, room: int) -> bool:
    """Whether {big, partner} dominates all feasible sets with big: three more never fit, and no two weigh more than partner."""
    low = [n for n in sizes if left[n] - (n == big) > 0][:3]
    smallest = [n for n in low for _ in range(min(3, left[n] - (n == big)))][:3]
    if len(smallest) > 2 and sum(smallest) <= room:
        return False
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return True
    usable = [n for n in sizes[: bisect_left(sizes, room + 1)] if left[n] - (n == big) > 0]
    i, j = 0, len(usable) - 1
    while i <= j:
        pair = usable[i] + usable[j]
        if pair > room or (i == j and left[usable[i]] - (usable[i] == big) < 2):
            j -= 1
        elif pair > partner:
            return False
        else:
            i += 1
    return True


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of bins."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    runs: list[Run] = []
    bins = 0

    def place(length: int, count: int, per_bin: int, first: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, per_bin, first, offset))
        used[length] += count

    for big, partner, copies in fixed:
        place(big, copies, 1, bins, 0)
        if partner:
            place(partner, copies, 1, bins, big)
        bins += copies
    rooms: dict[int, list[tuple[int, int]]] = {capacity: []}
    order = [capacity]

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                order.insert(bisect_left(order, room), room)
            rooms[room].append((first, n))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            i = bisect_left(order, length)
            while i < len(order) and not rooms[order[i]]:
                del rooms[order[i]], order[i]
            if i < len(order):
                room = order[i]
                first, n = rooms[room].pop()
            else:
                room, first = capacity, bins
                n = -(-todo // (capacity // length))
                bins += n
            per_bin = room // length
            full = min(n, todo // per_bin)
            if full:
                place(length, full * per_bin, per_bin, first, capacity - room)
                todo -= full * per_bin
                add(room - per_bin * length, first, full)
            if full < n and todo:
                place(length, todo, todo, first + full, capacity - room)
                add(room - todo * length, first + full, 1)
                add(room, first + full + 1, n - full - 1)
                todo = 0
            else:
                add(room, first + full, n - full)
    return runs, bins


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, with_tokens: bool = False, max_plan: int = 2_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and tokens) of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int" + ", tokens array<int>" * with_tokens
    pieces = written(plain_text(docs).mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_tokens), schema), "pieces")
    per_task = pieces.groupBy("length", "task").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, _ = plan_packing(counts, capacity)
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    if len(runs) > max_plan:
        return _placed_by_join(ranked, runs)
    tail = ", tokens array<int>" * with_tokens
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["tokens"] * with_tokens).mapInArrow(
        _places(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + tail
    )


def _places(runs: list[Run]):
    runs = sorted(runs, key=lambda r: (r.length, r.rank))
    length, rank, per_bin, first, offset = (np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "rank", "per_bin", "bin", "offset"))
    key = length * (1 << 48) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, own = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, size * (1 << 48) + own, "right") - 1
            x = own - rank[at]
            columns = {b.schema.names[i]: b.column(i) for i in range(5)}
            columns |= {"sequence_id": pa.array(first[at] + x // per_bin[at]), "offset": pa.array(offset[at] + x % per_bin[at] * size)}
            columns |= {b.schema.names[i]: b.column(i) for i in range(6, b.num_columns)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _placed_by_join(ranked: DataFrame, runs: list[Run]) -> DataFrame:
    """The same placing for a plan too large to broadcast: each run is a row, found by length and rank."""
    plan = ranked.sparkSession.createDataFrame(
        [(r.length, r.rank, r.count, r.per_bin, r.bin, r.offset) for r in runs], "length long, from long, count long, per_bin long, bin long, at long"
    )
    x = F.col("rank") - F.col("from")
    joined = ranked.join(plan, "length").where((x >= 0) & (x < F.col("count")))
    return joined.withColumns(
        {"sequence_id": F.col("bin") + F.floor(x / F.col("per_bin")), "offset": F.col("at") + F.pmod(x, F.col("per_bin")) * F.col("length")}
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *[c for c in ranked.columns if c == "tokens"])
