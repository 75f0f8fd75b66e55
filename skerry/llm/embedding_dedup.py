"""Operator 8, embedding near-dedup by an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook of ``k`` words;
the product of the two is a grid of cells.  Every vector is indexed in its
nearest cell.  As a query it visits cells by the multi-sequence order: cells
(i, j) by rising b1[i]^2 + b2[j]^2, where b is how far the half lies from the
bisecting plane towards that codeword.  The traversal stops where, on sampled
vectors turned by exactly the threshold angle, ``recall`` of them have been
reached.  What it meets is verified by exact cosine in double precision.

Vectors link within one label (and one width) only.  Equal vectors of a label
form one class; the search runs over classes, and counts carry their sizes.

Scale.  Codebooks are fitted on at most ``sample`` vectors; k follows the
size of the label that the mean vector is in, so cells hold about
``cell_rows`` even where one label holds most rows.  A cell's index rows and
its visitors are both dealt to blocks of at most ``block``, so a hot label or
cell becomes many tasks.  What travels is the vector as it came, in single
precision; it is made a unit vector in double precision where it is compared.  Each block returns a count per visitor and a
spanning forest of its links, never its pairs.

Defined results.  Vectors that are null, empty, zero, or hold null or
non-finite components, and rows with a null label, link with nothing and are
their own component.  A row with a null vec_id links with nothing, has a null
component and is not kept.  Rows are kept one to one, and rows that repeat a
vector count as others.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(near, x[:, d], len(centres))
            centres[n > 0, d] = sums[n > 0] / n[n > 0]
    return np.unique(centres, axis=0)


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, and how far a query goes."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float = 0.0

    def _distances(self, x: np.ndarray, half: int) -> np.ndarray:
        c = self.books[half]
        part = x[:, : x.shape[1] // 2] if half == 0 else x[:, x.shape[1] // 2 :]
        return np.maximum(0, (part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each vector."""
        return np.argmin(self._distances(x, 0), 1) * len(self.books[1]) + np.argmin(self._distances(x, 1), 1)

    def bounds(self, x: np.ndarray, half: int) -> np.ndarray:
        """Squared distance of each half from the plane between its own codeword and every other."""
        d, c = self._distances(x, half), self.books[half]
        near = np.argmin(d, 1)
        apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 1e-12))
        gap = (d - d[np.arange(len(d)), near][:, None]) / (2 * apart[near])
        gap[np.arange(len(d)), near] = 0
        return gap**2

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Cells that each vector visits: the multi-sequence prefix up to ``reach``."""
        first, second = self.bounds(x, 0), self.bounds(x, 1)
        for a, b in zip(first, second):
            i = np.flatnonzero(a <= self.reach)
            order = np.argsort(b)
            n = np.searchsorted(b[order], self.reach - a[i], "right")
            yield np.concatenate([p * len(b) + order[:m] for p, m in zip(i, n)])


def fit(x: np.ndarray, k: int, cosine: float, recall: float) -> MultiIndex:
    """Codebooks of a sample of unit vectors, and the reach that finds ``recall`` of vectors turned to ``cosine``."""
    cut = x.shape[1] // 2
    index = MultiIndex((_kmeans(x[:, :cut], k), _kmeans(x[:, cut:], k)))
    rng = np.random.default_rng(5)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
    there = index.cells(cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * turn)
    rows, width = np.arange(len(x)), len(index.books[1])
    gone = index.bounds(x, 0)[rows, there // width] + index.bounds(x, 1)[rows, there % width]
    return MultiIndex(index.books, float(np.quantile(gone, recall, method="higher")) + 1e-12)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros (their width is part of the key)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    out = np.zeros((len(column), width))
    lengths = np.diff(np.concatenate([[0], ends]))
    at = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = flat
    return out


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _place(index: MultiIndex, width: int):
    """Classes to index rows (visitor false) and query rows (visitor true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                flat = _padded(b.column(4), width)
                x = _normed(flat)
                visits = list(index.visits(x))
                n = np.array([len(v) for v in visits])
                row = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), n)])
                cell = np.concatenate([index.cells(x), *visits])
                visitor = np.repeat([False, True], [len(x), len(row) - len(x)])
                take = pa.array(row)
                raw = pa.array([v.tobytes() for v in flat.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_pydict(
                    {"visitor": pa.array(visitor), "label": b.column(0).take(take), "width": b.column(1).take(take), "cell": pa.array(cell, pa.int64()), "rep": b.column(2).take(take), "n": b.column(3).take(take), "vector": raw.take(take)}
                )

    return run


def _verify(cosine: float):
    """Rows (label, width, cell, part, guest, visitor, rep, n, vector) sorted by block to (rep, links, root)."""

    def settle(rows: list[tuple]) -> list[tuple[int, int, int]]:
        ours, theirs = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not ours or not theirs:
            return []
        x, y = (_normed(np.frombuffer(b"".join(r[3] for r in side), np.float32).reshape(len(side), -1).astype(np.float64)) for side in (ours, theirs))
        a, b = (np.array([r[1] for r in side], np.int64) for side in (ours, theirs))
        hit = (x @ y.T >= cosine) & (a[:, None] != b)
        links = hit @ np.array([r[2] for r in theirs], np.int64)
        rows_a, rows_b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows_a):
            return []
        hit, root_a, root_b = hit[np.ix_(rows_a, rows_b)], a[rows_a], b[rows_b]
        most = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(root_a, np.where(hit, root_b, most).min(1))
            new_b = np.minimum(root_b, np.where(hit, new_a[:, None], most).min(0))
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        return [*zip(a[rows_a].tolist(), links[rows_a].tolist(), root_a.tolist()), *((int(i), 0, int(r)) for i, r in zip(b[rows_b], root_b))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if row[:5] != key:
                    out += settle(rows)
                    key, rows = row[:5], []
                    if len(out) > 4096:
                        yield _found(out)
                        out = []
                rows.append(row[5:])
        out += settle(rows)
        yield _found(out)

    return run


def _found(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("rep", "links", "root"))})


def near_duplicates(
    vectors: DataFrame, *, cosine: float = 0.93, recall: float = 0.995, sample: int = 10_000, cell_rows: int = 400, max_words: int = 512, block: int = 1024
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<float>").alias("embedding"))
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    keyed = rows.select("vec_id", "label", *key, F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = written(
        rows.where(sound).select("vec_id", "label", "embedding", *key).groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vectors"
    )
    by_label = classes.groupBy("label").agg(F.count("*").cast("double").alias("n"), F.max(F.size("embedding")).alias("width"))
    n_classes, squares, width = by_label.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("width")).first()
    unlinked = keyed.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n_classes:
        return unlinked
    width += width % 2
    taken = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    k = max(2, min(max_words, math.ceil(math.sqrt(squares / n_classes / cell_rows))))
    index = fit(_normed(_padded(taken, width)), k, cosine, recall)
    places = written(
        classes.select("label", F.size("embedding").alias("width"), "rep", "n", "embedding").mapInArrow(_place(index, width), "visitor boolean, label long, width int, cell long, rep long, n long, vector binary"),
        "cells",
    )
    cell = ["label", "width", "cell"]
    counts = written(places.groupBy(*cell).agg(F.count_if(~F.col("visitor")).alias("own"), F.count_if("visitor").alias("guests")).where("own > 0"), "cell-sizes")
    n_parts, n_guests = (F.ceil(F.col(c) / block).cast("int") for c in ("own", "guests"))
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = places.join(counts, cell).select(
        *cell,
        F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array(deal(n_parts)))).alias("part"),
        F.when(F.col("visitor"), F.array(deal(n_guests))).otherwise(F.sequence(F.lit(0), n_guests - 1)).alias("guest"),
        "visitor", "rep", "n", "vector",
    )
    blocks = [*cell, "part", "guest"]
    dealt = dealt.select(*cell, "part", F.explode("guest").alias("guest"), "visitor", "rep", "n", "vector")
    found = written(dealt.repartition(parts, *blocks).sortWithinPartitions(*blocks).mapInArrow(_verify(cosine), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    settled = classes.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    settled = written(
        settled.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "settled"
    )
    linked = keyed.where("sound").join(settled, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(unlinked)
