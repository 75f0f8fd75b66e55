"""What the two text classifiers share: folds, the bounded training sample, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, plain_text, small_batches, text_of, texts_in

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled documents, the least by hash of the id.

    Null ids and labels teach nothing; a document labelled twice has its
    larger label.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, label) of the few ids in ``chosen(doc_id, label)``, which is broadcast; of several texts of an id the least."""
    return plain_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def any_rows(docs: DataFrame, most: int) -> DataFrame:
    """(text, label 0) of at most ``most`` documents outside the held-out fold, the least by hash of the id, labelled or not.

    Only ids whose hash falls into four times the share asked for are sorted; where most ids repeat, fewer than ``most`` may come.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    share = 4 * most / max(1, docs.count())
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
    some = ids.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & low).distinct()
    return texts_of(docs, some.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most).withColumn("label", F.lit(0)))


def collect_features(rows: DataFrame, extract: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CSR of the training rows on the driver: row pointer, ids, counts, labels; sorted by content, so runs repeat exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_pylist()
            for lo, hi, raw, offsets in byte_slices(b.column(0)):
                ptr, ids, counts, _ = extract(raw, offsets)
                out = [(ids[x:y].astype("<i4").tobytes(), counts[x:y].astype("<u4").tobytes()) for x, y in zip(ptr[:-1], ptr[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"ids": pa.array([x[0] for x in out], pa.binary()), "counts": pa.array([x[1] for x in out], pa.binary()), "label": pa.array(labels[lo:hi], pa.int32())}
                )

    got = sorted(rows.mapInArrow(run, "ids binary, counts binary, label int").toArrow().to_pylist(), key=lambda r: (r["ids"], r["counts"], r["label"]))
    ids = np.frombuffer(b"".join(r["ids"] for r in got), "<i4")
    counts = np.frombuffer(b"".join(r["counts"] for r in got), "<u4")
    ptr = np.concatenate([[0], np.cumsum([len(r["ids"]) // 4 for r in got])]).astype(np.int64)
    return ptr, ids, counts, np.array([r["label"] for r in got], np.int64)


def by_id(docs: DataFrame) -> DataFrame:
    """(row struct<doc_id>, text)."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), text_of().alias("text"))


def scored(rows: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(row, score) of ``rows`` of (row) or (row, text); ``score`` maps (bytes, offsets) of a run of texts to probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [score(raw, offsets) for _, _, raw, offsets in byte_slices(texts_in(b))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "score": pa.array(values, pa.float64())})

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
