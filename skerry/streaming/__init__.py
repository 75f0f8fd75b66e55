"""Incremental indexing from a stream of documents."""

from .incremental import index_batch, index_stream

__all__ = ["index_batch", "index_stream"]
