"""Shared plumbing: durable intermediates, column hygiene, Arrow batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one is made on a local master only.

    On a cluster a folder of the driver's own is of no use to the executors, so an unset folder raises there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skerry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows to an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``ARROW_ROWS``, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The plan after it starts from files that every executor can read, so a
    lost executor costs one task and never the stages before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def plain_text(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), text never null; any further columns are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of ``docs``; ``texts_in`` finds the text in it."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def texts_in(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of (row) or (row, text), null as the empty text."""
    own = batch.column(1) if batch.num_columns > 1 else batch.column(0).field(batch.column(0).type.get_field_index("text"))
    if own.null_count:
        own = pc.fill_null(own, "")
    return own


def with_text(docs: DataFrame, row: str, changed: Column, text: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, with ``text`` (and n_chars) replaced where ``changed``."""
    new = {"text": text, "n_chars": F.length(text)}
    out = []
    for c in docs.columns:
        old = F.col(row)[c]
        out.append((F.when(changed, new[c]).otherwise(old) if c in new else old).cast(docs.schema[c].dataType).alias(c))
    return out


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes.

    Yields (first row, row after the last, UTF-8 bytes, byte offset of each row
    and of the end).  The bytes are views, nothing is copied.  A single longer
    text comes alone and whole.
    """
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
