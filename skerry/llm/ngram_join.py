"""Operator 1, n-gram Jaccard join by prefix trees.

A text's set holds its distinct shingles of ``words`` words.  Two texts link
when the Jaccard similarity of their sets is at least ``percent`` / 100.  The
join is exact up to 57-bit shingle hashes.

Steps, and what each moves:

1. One pass counts shingles in a fixed-size sketch (2^24 counters) and gives
   each text its set size and a 128-bit digest of its set.  Texts with equal
   sets are one class; from here on its least doc_id stands for it.
2. All sets are put in one global order, rare shingles first by the sketch.
   Linked sets share c shingles among the first n - ceil(n * percent / 100) + c
   of each side, for any c.  Prefixes for c = n / 20 meet by shingle, and a text
   with fewer shared ones than that goes no further: nearly all.  Among the
   others the prefixes for c = 1 meet again; the smallest set of a shingle is
   its *hub*, and a document belongs to the buckets of its hubs.
3. What follows a hub's first shingle in a set bounds the overlap found there,
   and so the size of a partner; who can't reach the hub's size leaves the
   bucket.  So texts that share a passage and nothing else stay together only
   where they link.  A bucket of more than ``block`` members is cut by size
   into overlapping ones, and those are dealt to blocks of ``block`` members
   (or that many times MEMBER_SHINGLES shingles) with the least set, the
   *leader*, in each, so a bucket of any size becomes many tasks.
   Inside a block the ordered sets form a prefix tree.  A probe walks it,
   carries the overlap along shared prefixes, and leaves a subtree when
   overlap plus the lesser remaining length falls short.  Subtrees already in
   the probe's component are left too.  Only a spanning forest goes out.
4. Members that are not in their leader's component after that are probed
   against the other blocks of the bucket, ``probes`` to a task and one at a
   time, so no link between blocks is lost.
5. Components of the forest, distributed; classes get their component back.

The joins on texts, postings and classes are merge joins at every size, so the
plan that runs on little data is the one that runs on much.

Defined results.  A-Z is lower-cased.  Fewer words than ``words`` are one
shingle.  Texts without words (null, empty) have an empty set, link with
nothing and are their own component.  Rows are kept one to one and each is
judged by its own text; rows that repeat a doc_id and text agree.  Rows with
a null doc_id get the component of their text's other documents, null if there
are none.  Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, plain_text, text_of, written
from .components import components
from .textvec import LOWER, mix, ngrams, words_of

_U = np.uint64
SKETCH_BITS, SLOTS = 24, 64
#: Shingles to a tree node, so that bounds are looked at often.
SEGMENT = 16


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted by text and hash."""
    found = words_of(LOWER[raw], offsets)
    grams, at = ngrams(found, words)
    doc = found.doc[at]
    count = np.diff(found.first)
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.full(len(short), n, np.uint64)
            for j in range(n):
                h = mix(h * _U(0xD6E8FEB86659FD93) + found.hash[found.first[short] + j])
            grams, doc = np.concatenate([grams, h]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each of n texts; ``doc`` is sorted."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    cut = np.searchsorted(doc, np.arange(n + 1))
    return total[cut[1:]] - total[cut[:-1]]


def _digests(grams: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit sums that tell each text's set of shingles."""
    return tuple(pa.array(_sums(mix(grams ^ _U(seed)), doc, n).view(np.int64)) for seed in (0, 0x5851F42D4C957F2D))


_SETS = "doc_id long, n long, d1 long, d2 long, slot int, sketch binary"


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint16)
        for b in batches:
            for lo, hi, raw, offsets in byte_slices(b.column(1)):
                doc, grams = shingle_sets(raw, offsets, words)
                n = np.bincount(doc, minlength=hi - lo)
                d1, d2 = _digests(grams, doc, hi - lo)
                at, own = np.unique(grams >> _U(64 - SKETCH_BITS), return_counts=True)
                counters[at] = np.minimum(counters[at] + own, 255)
                none = pa.nulls(hi - lo, pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column(0).slice(lo, hi - lo), "n": pa.array(n, pa.int64()), "d1": d1, "d2": d2, "slot": none, "sketch": pa.nulls(hi - lo, pa.binary())}
                )
        own = [(i, zlib.compress(c.astype(np.uint8).tobytes(), 1)) for i, c in enumerate(np.split(counters, SLOTS)) if c.any()]
        null = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": null, "n": null, "d1": null, "d2": null, "slot": pa.array([x[0] for x in own], pa.int32()), "sketch": pa.array([x[1] for x in own], pa.binary())})

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rarity classes, two to an octave, of the counters summed over all tasks; every row of a slot is in one partition."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, part in zip(b.column(0).to_pylist(), b.column(1)):
            if slot not in sums:
                sums[slot] = np.zeros((1 << SKETCH_BITS) // SLOTS, np.int64)
            sums[slot] += np.frombuffer(zlib.decompress(part.as_py()), np.uint8)
    levels = [np.minimum(63, 2 * np.log2(s + 1.0)).astype(np.uint8).tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_pydict({"slot": pa.array(list(sums), pa.int32()), "sketch": pa.array(levels, pa.binary())})


def _levels(described: DataFrame) -> np.ndarray:
    """Rarity class of each sketch counter; 2^SKETCH_BITS bytes whatever the corpus."""
    parts = described.where("slot is not null").select("slot", "sketch").repartition(SLOTS, "slot").mapInArrow(_add_sketches, "slot int, sketch binary").toArrow().to_pylist()
    levels = np.zeros((SLOTS, (1 << SKETCH_BITS) // SLOTS), np.uint8)
    for p in parts:
        levels[p["slot"]] = np.frombuffer(p["sketch"], np.uint8)
    return levels.reshape(-1)


def _in_order(doc: np.ndarray, grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles of each text as numbers whose order is the global one: rarity class, then hash."""
    level = levels[(grams >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    token = ((level << _U(57)) | (grams >> _U(7))).view(np.int64)
    return token[np.lexsort((token, doc))]


#: A longer prefix by n / EXTRA shingles must share as many; more of it prunes more and moves more.
EXTRA = 20


def _common(n):
    """Shingles that linked sets share in prefixes of n - ceil(n * percent / 100) + this many, for a set of n."""
    return np.maximum(1, n // EXTRA)


def _prefixes(words: int, percent: int, levels: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in byte_slices(b.column(1)):
                doc, grams = shingle_sets(raw, offsets, words)
                n = np.bincount(doc, minlength=hi - lo)
                d1, d2 = _digests(grams, doc, hi - lo)
                token = _in_order(doc, grams, levels.value)
                first = np.cumsum(n) - n
                length = np.where(n > 0, n + (-percent * n // 100) + _common(n), 0)
                ends = np.cumsum(length)
                at = np.arange(ends[-1]) + np.repeat(first - (ends - length), length)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(token[at]))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "n": pa.array(n, pa.int64()), "d1": d1, "d2": d2, "prefix": lists})

    return run


class Forest:
    """Union-find over small whole numbers; the root is the least id in ``ids``."""

    def __init__(self, ids: list[int]):
        self.ids, self.up = ids, list(range(len(ids)))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.ids[j] < self.ids[i]:
                i, j = j, i
            self.up[j] = i


class _Node:
    __slots__ = ("children", "ends", "last", "least", "only", "tokens")

    def __init__(self, tokens: tuple[int, ...], member: int, n: int):
        self.tokens, self.last = frozenset(tokens), tokens[-1]
        self.children: dict[tuple[int, ...], _Node] = {}
        self.ends: list[int] = []
        self.least = n
        self.only: int | None = member


class PrefixTree:
    """Ordered sets as paths of segments; sets that begin alike share nodes and the overlap found there."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root: dict[tuple[int, ...], _Node] = {}
        self.members = 0

    def needed(self, x: int, y: int) -> int:
        """Least overlap of sets of these sizes that links: 100 o >= percent (x + y - o)."""
        return -(-self.percent * (x + y) // (100 + self.percent))

    def add(self, tokens: tuple[int, ...]) -> int:
        member, n, level = self.members, len(tokens), self.root
        self.members += 1
        node = None
        for i in range(0, n, SEGMENT):
            part = tokens[i : i + SEGMENT]
            node = level.get(part)
            if node is None:
                node = level[part] = _Node(part, member, n)
            elif node.only != member:
                node.only = None
            node.least = min(node.least, n)
            level = node.children
        if node is not None:
            node.ends.append(member)
        return member

    def links(self, tokens: tuple[int, ...], skip) -> Iterator[int]:
        """Members whose set links with the probe; ``skip(member)`` tells which need not be found."""
        own, size = frozenset(tokens), len(tokens)
        stack = [(node, 0, 0) for node in self.root.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if node.only is not None and skip(node.only):
                continue
            overlap += len(own & node.tokens)
            depth += len(node.tokens)
            for m in node.ends:
                if overlap >= self.needed(size, depth) and not skip(m):
                    yield m
            if node.children:
                # the shorter the other set, the less is needed, and the fewer of its shingles may be missing from the probe
                left = size - bisect_right(tokens, node.last)
                if overlap + left >= self.needed(size, node.least) and depth - overlap <= _spare(size, depth, self.percent):
                    stack += [(child, overlap, depth) for child in node.children.values()]


def _spare(size: int, depth: int, percent: int) -> int:
    """Most shingles a linking set of any feasible size may have that the probe lacks: y - needed(size, y), y <= size * 100 / percent."""
    y = max(depth, size * 100 // percent)
    return y - -(-percent * (size + y) // (100 + percent))


#: What tells a block of a bucket, and the rows that are joined there.
_BLOCK = ["hub", "sub", "block", "part"]
_EDGE = "hub long, sub int, block int, a long, b long, left boolean"


class _Block:
    """One block: the tree of its members, a forest over all its rows, and the edges of a spanning forest."""

    def __init__(self, key: tuple, percent: int):
        self.key, self.tree, self.forest = key, PrefixTree(percent), Forest([])
        self.row_of: list[int] = []
        self.last: tuple | None = None
        self.leaders: list[int] = []
        self.dealt = False

    def take(self, doc_id: int, tokens: tuple[int, ...], role: int, dealt: bool) -> None:
        """A member (role 1 where it leads the bucket) or a probe (role 2), or a member that meets probes only (role 3)."""
        if (doc_id, role, tokens) == self.last:
            return
        self.last = (doc_id, role, tokens)
        forest = self.forest
        i = len(forest.ids)
        forest.ids.append(doc_id)
        forest.up.append(i)
        self.dealt |= dealt
        if role == 1:
            self.leaders.append(i)
        if role != 3:
            for m in self.tree.links(tokens, lambda m: forest.find(self.row_of[m]) == forest.find(i)):
                forest.join(i, self.row_of[m])
        if role != 2:
            self.tree.add(tokens)
            self.row_of.append(i)

    def edges(self) -> list[tuple]:
        forest = self.forest
        out = [(*self.key[:3], own, forest.ids[forest.find(i)], False) for i, own in enumerate(forest.ids) if own != forest.ids[forest.find(i)]]
        if self.dealt and self.leaders:
            leader = min(forest.ids[i] for i in self.leaders)
            at = {forest.find(i) for i in self.leaders if forest.ids[i] == leader}
            out += [(*self.key[:3], own, leader, True) for i, own in enumerate(forest.ids) if forest.find(i) not in at and own != leader]
        return out


def _join_blocks(words: int, percent: int, levels: Broadcast):
    """Rows (hub, sub, block, part, role, dealt, doc_id, text), sorted by block with probes last, to edges and to members left over.

    Sets are made for a slice of rows at a time, probes are met as they come;
    what is held is one block's tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        out: list[tuple] = []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            roles, dealt, ids = (b.column(i).to_pylist() for i in (4, 5, 6))
            for lo, hi, raw, offsets in byte_slices(b.column(7)):
                doc, grams = shingle_sets(raw, offsets, words)
                token = _in_order(doc, grams, levels.value)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    if block is None or keys[i] != block.key:
                        if block is not None:
                            out += block.edges()
                        block = _Block(keys[i], percent)
                    block.take(ids[i], tuple(token[cut[i - lo] : cut[i - lo + 1]].tolist()), roles[i], dealt[i])
                    if len(out) > 4096:
                        yield _edges(out)
                        out = []
        if block is not None:
            out += block.edges()
        yield _edges(out)

    return run


def _edges(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"hub": pa.int64(), "sub": pa.int32(), "block": pa.int32(), "a": pa.int64(), "b": pa.int64(), "left": pa.bool_()}
    return pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds.items())})


#: A block's members have this many shingles each at most, on average.
MEMBER_SHINGLES = 1024
#: Blocks to a row while a leader is dealt to all of its bucket's blocks.
SPREAD = 256
#: Ways that the rows of one bucket are dealt where its sizes are looked up.
SALTS = 16


def _dealt(belongs: DataFrame, percent: int, block: int) -> DataFrame:
    """Places (doc_id, hub, sub, low, high, blocks, role) of ``belongs`` (hub, doc_id, rank, n, rest): members at block low, leaders at low to high - 1.

    A bucket of more than a block is cut by set size into overlapping ones,
    each of sizes that differ by less than percent / 100 squared, and those are
    dealt to blocks.  ``most`` bounds the size of a set that a member could
    link with over this bucket's shingles: who can't reach its least set goes.
    """
    most = F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n")
    rows = belongs.withColumns({"most": most, "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    rows = rows.where(F.col("most") >= F.shiftright("hub", 32))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / (block * MEMBER_SHINGLES))).cast("int")
    buckets = written(rows.groupBy("hub").agg(blocks.alias("blocks"), F.count("*").alias("rows")).where("rows > 1"), "buckets")
    sized = written(rows.join(buckets.where("blocks > 1").select("hub", "blocks", salts), ["hub", "salt"], "left"), "sized")
    leads = (F.col("rank") == F.col("hub")).cast("int")
    small = sized.where("blocks is null").join(buckets.where("blocks = 1").select("hub"), "hub", "left_semi")
    small = small.select("doc_id", "hub", F.lit(-1).alias("sub"), F.lit(0).alias("low"), F.lit(1).alias("high"), F.lit(1).alias("blocks"), leads.alias("role"))
    band = F.floor(F.log("n") / max(0.01, math.log(100 / percent) * 1.001)).cast("int")
    cut = sized.where("blocks > 1").drop("blocks").withColumn("sub", F.explode(F.array(band, band - 1)))
    subs = written(cut.groupBy("hub", "sub").agg(F.min("rank").alias("leader"), blocks.alias("blocks"), F.count("*").alias("rows")), "sub-buckets")
    placed = cut.join(subs.where("rows > 1").select("hub", "sub", "leader", "blocks", salts), ["hub", "sub", "salt"]).where(F.col("most") >= F.shiftright("leader", 32))
    leads = F.col("rank") == F.col("leader")
    own = F.pmod(F.xxhash64("doc_id", "hub"), F.col("blocks")).cast("int")
    low = F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(SPREAD))).otherwise(F.array(own)))
    wide = placed.select("doc_id", "hub", "sub", low.alias("low"), "blocks", leads.cast("int").alias("role"))
    high = F.when(F.col("role") == 1, F.least("blocks", F.col("low") + SPREAD)).otherwise(F.col("low") + 1)
    return small.unionByName(wide.select("doc_id", "hub", "sub", "low", high.alias("high"), "blocks", "role"))


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80, block: int = 128, probes: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = plain_text(docs)
    described = written(texts.mapInArrow(_describe(words), _SETS), "sets")
    levels = spark.sparkContext.broadcast(_levels(described))  # 2^SKETCH_BITS bytes
    rows = described.where("slot is null").drop("slot", "sketch")
    sets = texts.mapInArrow(_prefixes(words, percent, levels), "doc_id long, n long, d1 long, d2 long, prefix array<long>").where("n > 0")
    classes = written(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("prefix").alias("prefix")).where("doc_id is not null"), "classes")
    rank = F.shiftleft("n", 32).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFF)).alias("rank")
    postings = classes.select("doc_id", "n", rank, F.posexplode("prefix").alias("at", "token"))

    def in_two(rows: DataFrame, name: str) -> DataFrame:
        held = rows.groupBy("token").agg(F.min("rank").alias("hub"), F.count("*").alias("sets"))
        return written(rows.join(written(held.where("sets > 1").select("token", "hub"), "shared").hint("merge"), "token"), name)

    shared = in_two(postings, "postings")
    least = -F.floor(F.col("n") * -percent / 100)
    live = shared.groupBy("doc_id", "n").count().where(F.col("count") >= F.greatest(F.lit(1), F.floor(least / EXTRA))).select("doc_id")
    first = shared.where(F.col("at") <= F.col("n") - least).drop("hub").join(written(live, "live"), "doc_id", "left_semi")
    meetings = in_two(first, "meetings")
    belongs = written(meetings.groupBy("hub", "doc_id", "rank", "n").agg(F.max(F.col("n") - F.col("at")).alias("rest")), "belongs")
    place = F.struct("hub", "sub", "low", "high", "blocks", "role")
    places = written(_dealt(belongs, percent, block).groupBy("doc_id").agg(F.collect_list(place).alias("places")), "places")
    placed = written(texts.join(places.hint("merge"), "doc_id").select("doc_id", "text", F.explode("places").alias("p")).select("doc_id", "text", "p.*"), "members")

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.select(*_BLOCK, "role", (F.col("blocks") > 1).alias("dealt"), "doc_id", "text")
        order = [*_BLOCK, F.col("role").desc(), "doc_id"]
        return rows.repartition(parts, *_BLOCK).sortWithinPartitions(*order).mapInArrow(_join_blocks(words, percent, levels), _EDGE)

    each = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("block")
    members = placed.select("hub", "sub", each, F.lit(0).alias("part"), "role", "blocks", "doc_id", "text")
    found = written(joined(members), "links")
    left = found.where("left").select("hub", "sub", "block", F.col("a").alias("doc_id")).distinct()
    edges = found.where("not left").select("a", "b")
    if not left.isEmpty():
        many = written(left.groupBy("hub", "sub").agg(F.ceil(F.count("*") / probes).cast("int").alias("parts")), "probed")
        wide = members.where("blocks > 1").drop("part", "role").join(many, ["hub", "sub"])
        targets = wide.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(3)})
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
        asking = wide.join(left, ["hub", "sub", "block", "doc_id"], "left_semi").withColumn("block", F.explode(others))
        asking = asking.withColumns({"part": F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), "role": F.lit(2)})
        edges = edges.unionByName(joined(targets.unionByName(asking)).where("not left").select("a", "b"))
    labels = components(edges)
    reps = classes.select("d1", "d2", F.col("doc_id").alias("rep"))
    settled = written(reps.join(labels, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id")), "settled")
    out = rows.join(settled.hint("merge"), ["d1", "d2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id's, and one of the rows that repeat its doc_id and text.

    Texts without words and rows without id stay as they are.
    """
    found = jaccard_components(docs, words=words, percent=percent, block=block)
    gone = (F.col("doc_id") != F.col("component_id")).cast("int")
    marks = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.max(gone).alias("gone"), F.count("*").alias("n")).where("gone = 1 or n > 1")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = whole.join(marks, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left").where("gone is null or gone = 0")
    again = F.col("n").isNotNull() & text_of("row.text").rlike(r"[^\x20\x09-\x0D]")
    once = marked.where(F.coalesce(again, F.lit(False))).groupBy("doc_id", F.sha2(text_of("row.text"), 256)).agg(F.first("row").alias("row")).select("row")
    return marked.where(~F.coalesce(again, F.lit(False))).select("row").unionByName(once).select("row.*")
