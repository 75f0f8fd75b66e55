"""Documents to parsed documents: format dispatch in the JVM, block parsing in one Arrow stage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_html
from ..schema import PARSED
from .html import parse_html
from .markdown import parse_markdown

_BLOCK = pa.struct([("heading_path", pa.list_(pa.string())), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])
_PARSED = pa.struct([("title", pa.string()), ("text", pa.string()), ("blocks", pa.list_(_BLOCK))])


def parse_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with ``parsed`` struct<title,text,blocks>; null text parses as empty."""
    content_type = F.coalesce(F.element_at("metadata", "contentType"), F.lit("")) if "metadata" in documents.columns else F.lit("")
    rows = documents.select(
        F.struct(*documents.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("uri", F.lit("")).alias("uri"), is_html(content_type, F.col("uri"), F.col("text")).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                parsed = [parse_html(t, u) if h else parse_markdown(t) for t, u, h in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
                yield pa.RecordBatch.from_pydict({"row": b.column(0), "parsed": pa.array(parsed, _PARSED)})

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, parsed {PARSED}")
    return out.select("row.*", "parsed")


def blocks(parsed: DataFrame) -> DataFrame:
    """One row a block: id, ord, heading_path, text, char_start, char_end."""
    return parsed.select("id", F.posexplode("parsed.blocks").alias("ord", "block")).select("id", "ord", "block.*")
