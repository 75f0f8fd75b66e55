"""Exact cosine search of a batch of queries over all vectors of a namespace.

Queries go in blocks of at most ``QUERY_BLOCK`` (a stated query set against
all rows): each task multiplies its Arrow batches with the block and keeps the
best ``top_k`` of each query, so what is shuffled is queries x tasks x top_k,
never pairs.  The final ranking is a window over those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked
from .limits import check_query_vector, check_top_k

QUERY_BLOCK = 4096


def _best(queries: list[tuple], top_k: int):
    by_space: dict[str, list[tuple]] = {}
    for query_id, namespace, vector in queries:
        by_space.setdefault(namespace, []).append((query_id, vector))
    packed = {}
    for space, own in by_space.items():
        m = np.array([v for _, v in own], np.float64)
        packed[space] = ([q for q, _ in own], m / np.linalg.norm(m, axis=1)[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spaces = np.array(b.column(0).to_pylist(), object)
            ids = np.array(b.column(1).to_pylist(), object)
            vectors = b.column(2)
            width = vectors.offsets[1].as_py() - vectors.offsets[0].as_py() if len(vectors) else 0
            x = np.asarray(vectors.flatten(), np.float64).reshape(-1, width) if width else np.zeros((len(ids), 0))
            for space, (names, m) in packed.items():
                own = np.flatnonzero(spaces == space)
                if not len(own):
                    continue
                if m.shape[1] != width:
                    raise ValueError(f"the index holds vectors of width {width}, the query has {m.shape[1]}")
                own = own[np.argsort(ids[own], kind="stable")]
                part = x[own]
                scores = (part @ m.T) / np.linalg.norm(part, axis=1)[:, None]
                best = np.argsort(-scores, axis=0, kind="stable")[:top_k]
                at = best.T.ravel()  # query by query
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array([name for name in names for _ in range(len(best))]),
                        "namespace": pa.array([space] * len(at), pa.string()),
                        "id": pa.array(ids[own[at]].tolist()),
                        "score": pa.array(scores.T[np.repeat(np.arange(len(names)), len(best)), at]),
                    }
                )

    return run


def vector_search(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, namespace, id, score, rank); ``chunks(namespace, id, embedding)``, ``queries(query_id, namespace, vector)``.

    The namespace filter comes before the limit; all vectors of the index have one width.
    """
    check_top_k(top_k)
    rows = chunks.select("namespace", "id", "embedding").where(F.col("embedding").isNotNull())
    kinds = {c: t for c, t in queries.dtypes} | {c: t for c, t in rows.dtypes}
    schema = f"query_id {kinds['query_id']}, namespace string, id {kinds['id']}, score double"
    found, block = None, []

    def flush() -> DataFrame:
        part = rows.where(F.col("namespace").isin(sorted({q[1] for q in block}))).mapInArrow(_best(list(block), top_k), schema)
        return part if found is None else found.unionByName(part)

    for q in queries.select("query_id", "namespace", "vector").toLocalIterator():
        check_query_vector(q["vector"])
        block.append((q["query_id"], q["namespace"], list(q["vector"])))
        if len(block) == QUERY_BLOCK:
            found = flush()
            block = []
    if block or found is None:
        found = flush() if block else chunks.sparkSession.createDataFrame([], schema)
    return ranked(found, top_k)
