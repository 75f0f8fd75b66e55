"""Embedding texts in Arrow batches with a pluggable backend.

A backend is anything with ``embed(texts) -> list of vectors`` and
``count(text) -> int``; it is made once in every Python worker by a factory.
The built-in one is a deterministic hashing embedder, since no model files
come with the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...

    def count(self, text: str) -> int: ...


class HashingBackend:
    """Signed feature hashing of words and word pairs to unit vectors."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"[^\W_]+", text.lower())
            v = np.zeros(self.width)
            for f in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                v[(h >> 1) % self.width] += 1.0 if h & 1 else -1.0
            n = np.linalg.norm(v)
            v[0] = 1.0 if n == 0 else v[0]
            out.append((v / (n or 1.0)).tolist())
        return out

    def count(self, text: str) -> int:
        return max(1, len(text.split()))


@dataclass(frozen=True)
class Recipe:
    """What a model wants in front of a query and of a passage."""

    query: str = ""
    passage: str = ""


#: Prefixes by part of the model's name; others have none.
RECIPES = {
    "bge-small-en": Recipe(query="Represent this sentence for searching relevant passages: "),
    "e5": Recipe(query="query: ", passage="passage: "),
    "embeddinggemma": Recipe(query="task: search result | query: ", passage="title: none | text: "),
}


def recipe_of(model: str) -> Recipe:
    return next((r for name, r in RECIPES.items() if name in model), Recipe())


@dataclass(frozen=True)
class Embedder:
    """Documents and queries to vectors; ``factory`` makes the backend where it runs."""

    factory: Callable[[], Backend] = HashingBackend
    model: str = "hashing"
    batch: int = 16

    def probe(self) -> int:
        """Width of the backend's vectors; a backend that returns none is refused."""
        got = self._checked(self.factory(), ["test"])
        if not got or not len(got[0]):
            raise ValueError(f"{self.model} returned no vector for a test text")
        return len(got[0])

    @staticmethod
    def _checked(backend: Backend, texts: list[str]) -> list[list[float]]:
        got = [list(map(float, v)) for v in backend.embed(texts)]
        if len(got) != len(texts):
            raise ValueError(f"the backend returned {len(got)} vectors for {len(texts)} texts")
        return got

    def count_tokens(self, text: str) -> int:
        """Tokens of a passage with its prefix."""
        return self.factory().count(recipe_of(self.model).passage + text)

    def embed_query(self, text: str) -> list[float]:
        return self._checked(self.factory(), [recipe_of(self.model).query + text])[0]

    def embed_column(self, rows: DataFrame, text: str, *, into: str = "embedding", query: bool = False, progress: Accumulator | None = None) -> DataFrame:
        """``rows`` with the vector of a text column; ``progress`` counts the rows done (more than once where a task is retried)."""
        prefix = recipe_of(self.model).query if query else recipe_of(self.model).passage
        factory, size, checked = self.factory, self.batch, self._checked
        packed = rows.select(F.struct(*rows.columns).alias("row"), F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            backend = factory()
            for b in batches:
                texts = b.column(1).to_pylist()
                vectors = [v for lo in range(0, len(texts), size) for v in checked(backend, texts[lo : lo + size])]
                if progress is not None:
                    progress.add(len(texts))
                yield pa.RecordBatch.from_pydict({"row": b.column(0), into: pa.array(vectors, pa.list_(pa.float32()))})

        out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {into} array<float>")
        return out.select("row.*", into)
