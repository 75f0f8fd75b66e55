"""The two whole plans: documents into a store, and questions against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed_text
from ..operators.chunk import ChunkOptions, chunk_documents
from ..operators.embed import Embedder
from ..operators.fusion import WITHOUT_RERANKER, Weights, fuse
from ..operators.parse import parse_documents
from ..operators.store import ParquetStore, StoreWrite
from ..operators.sync import UpdatePlan, plan_update


def index_documents(
    store: ParquetStore, namespace: str, loaded: DataFrame, failures: DataFrame, embedder: Embedder | None = None, options: ChunkOptions | None = None, *, removals: bool = True
) -> dict[str, int]:
    """Bring ``namespace`` level with what was loaded; returns the summary.

    Unchanged documents are never parsed, and only chunks whose text is new are
    embedded.  With ``removals`` false (a stream's micro-batch is never the
    whole source) absent documents stay.
    """
    embedder = embedder or Embedder()
    indexed, held = store.snapshot(namespace)
    partial = failures if removals else failures.unionByName(store.spark.range(1).select(F.lit("").alias("uri"), F.lit("partial read").alias("reason")))
    plan: UpdatePlan = plan_update(loaded, partial, indexed, held, lambda docs: chunk_documents(parse_documents(docs), options)[0])
    fresh = plan.embed.persist()
    header = embed_text(F.col("title"), F.col("heading_path"), F.col("text"), header=(options or ChunkOptions()).header)
    vectors = embedder.embed_column(fresh.withColumn("__text", header), "__text").drop("__text")
    write = StoreWrite(upsert=vectors, restate=plan.restate, remove_chunks=plan.remove, remove_documents=plan.removed_documents, documents=plan.indexed_documents)
    summary = plan.summary.first().asDict()
    store.apply(namespace, write)
    fresh.unpersist()
    return summary


def search(store: ParquetStore, questions: DataFrame, embedder: Embedder | None = None, *, depth: int = 20, top_k: int = 5, weights: Weights = WITHOUT_RERANKER) -> DataFrame:
    """(query_id, id, score, ranks) of the fused lists for ``questions(query_id, namespace, q)``."""
    embedder = embedder or Embedder()
    vectors = embedder.embed_column(questions, "q", into="vector", query=True).select("query_id", "namespace", "vector")
    return fuse(store.lexical_search(questions, depth), store.vector_search(vectors, depth), weights, top_k=top_k)
