"""Index upkeep as a stream: every micro-batch is planned and applied like a partial read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import ChunkOptions
from ..operators.embed import Embedder
from ..operators.store import ParquetStore
from ..plans.index import index_documents
from ..schema import FAILURE


def index_batch(store: ParquetStore, namespace: str, batch: DataFrame, embedder: Embedder | None = None, options: ChunkOptions | None = None) -> dict[str, int]:
    """Apply one micro-batch of documents; documents not in it stay as they are.  Applying it again changes nothing."""
    none = store.spark.createDataFrame([], FAILURE)
    return index_documents(store, namespace, batch, none, embedder, options, removals=False)


def index_stream(documents: DataFrame, store: ParquetStore, namespace: str, checkpoint: str, embedder: Embedder | None = None, options: ChunkOptions | None = None, **trigger) -> StreamingQuery:
    """Start ``foreachBatch`` upkeep; a batch that is replayed after a failure finds its documents unchanged."""
    writer = documents.writeStream.foreachBatch(lambda df, _: index_batch(store, namespace, df, embedder, options) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
