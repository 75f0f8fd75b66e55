"""Chunks: blocks of one section packed to a token budget, with ids that come from their text alone.

Packing is sequential within a document and free of any other document, so it
is one Arrow stage without a shuffle; a document that cannot be chunked comes
back as a failure row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADER_SEPARATOR
from ..schema import CHUNK, CHUNK_COLUMNS
from .split import split

DEFAULT_MAX_TOKENS = 256


def quarter_of_characters(text: str) -> int:
    """The default counter; the same as ``functions.estimate_tokens``."""
    return math.ceil(len(text) / 4)


@dataclass(frozen=True)
class ChunkOptions:
    count_tokens: Callable[[str], int] = quarter_of_characters
    max_tokens: int = DEFAULT_MAX_TOKENS
    header: bool = True


class HeaderTooLong(ValueError):
    """The header alone spends the budget."""


def _embedded(title: str, path: tuple[str, ...], text: str, header: bool) -> str:
    named = [p for p in (title, *path) if p.strip()]
    return f"{HEADER_SEPARATOR.join(named)}\n{text}" if header and named else text


@dataclass
class _Open:
    path: tuple[str, ...]
    text: str
    low: int
    high: int
    tokens: int


def _pieces(blocks: list[dict], room: Callable, count: Callable) -> Iterator[_Open]:
    for b in blocks:
        path, text, low = tuple(b["heading_path"]), b["text"], b["char_start"]
        if count(text) <= room(path):
            yield _Open(path, text, low, b["char_end"], 0)
            continue
        at = 0
        for part in split(text, room(path), count):
            at = text.index(part, at)
            yield _Open(path, part, low + at, low + at + len(part), 0)
            at += len(part)


def chunk_document(doc: dict, blocks: list[dict], title: str, options: ChunkOptions) -> list[dict]:
    """Chunks of one document, in order, each different text once."""
    count, rooms = options.count_tokens, {}

    def room(path: tuple[str, ...]) -> int:
        if path not in rooms:
            left = options.max_tokens - count(_embedded(title, path, "", options.header))
            if left < 1:
                raise HeaderTooLong(f'in {doc["uri"]}, the header "{HEADER_SEPARATOR.join((title, *path))}" needs the whole budget of {options.max_tokens} tokens')
            rooms[path] = left
        return rooms[path]

    packed: list[_Open] = []
    for piece in _pieces(blocks, room, count):
        last = packed[-1] if packed else None
        if last is not None and last.path == piece.path:
            added = "\n\n" + piece.text
            # sums may overstate, so a sum that fits is enough and only one that does not is counted again
            total = last.tokens + count(added)
            if total > room(piece.path):
                total = count(last.text + added)
            if total <= room(piece.path):
                last.text, last.high, last.tokens = last.text + added, piece.high, total
                continue
        piece.tokens = count(piece.text)
        packed.append(piece)
    out: dict[str, dict] = {}
    for p in packed:
        text = _embedded(title, p.path, p.text, options.header)
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        if digest not in out:
            out[digest] = {
                "id": f"{doc['id']}-{digest[:12]}", "doc_id": doc["id"], "namespace": doc["namespace"], "uri": doc["uri"], "title": title, "heading_path": list(p.path),
                "text": p.text, "char_start": p.low, "char_end": p.high, "tokens": count(text), "hash": digest,
            }
    return list(out.values())


_TYPES = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in (f.split() for f in CHUNK.split(", "))] + [("reason", pa.string())])


def chunk_documents(parsed: DataFrame, options: ChunkOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures) of ``parsed(id, namespace, uri, title, parsed)``."""
    opts = options or ChunkOptions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                rows = []
                for doc in whole.slice(lo, 64).to_pylist():
                    own = doc["parsed"]["title"] or ""
                    title = own if own.strip() else (doc["title"] or "") if (doc["title"] or "").strip() else ""
                    try:
                        rows += [c | {"reason": None} for c in chunk_document(doc, doc["parsed"]["blocks"] or [], title, opts)]
                    except HeaderTooLong as e:
                        rows.append(dict.fromkeys(CHUNK_COLUMNS) | {"uri": doc["uri"], "reason": str(e)})
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    out = parsed.select("id", "namespace", "uri", "title", "parsed").mapInArrow(run, CHUNK + ", reason string")
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select("uri", "reason")


def fixed_windows(documents: DataFrame, size: int, *, text: str = "text") -> DataFrame:
    """(id, ord, text) of every ``size`` white-space-separated words, structure ignored; all in the JVM."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.floor((F.size("words") - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = documents.select("id", words.alias("words")).select("id", "words", F.explode(starts).alias("ord"))
    return rows.select("id", "ord", F.array_join(F.slice("words", F.col("ord") * size + 1, F.lit(size)), " ").alias("text"))
