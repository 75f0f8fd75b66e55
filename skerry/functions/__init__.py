"""Column functions of the engine."""

from .text import (
    chunk_id,
    content_hash,
    decode_entities,
    document_id,
    embed_text,
    estimate_tokens,
    is_html,
    normalize_evidence,
    path_title,
    search_text,
    stop_words_removed,
    strip_zero_width,
    terms,
    url_title,
)
from .vectors import cosine, cosine_of_unit_distance, l2_normalize, norm

__all__ = [
    "chunk_id",
    "content_hash",
    "cosine",
    "cosine_of_unit_distance",
    "decode_entities",
    "document_id",
    "embed_text",
    "estimate_tokens",
    "is_html",
    "l2_normalize",
    "norm",
    "normalize_evidence",
    "path_title",
    "search_text",
    "stop_words_removed",
    "strip_zero_width",
    "terms",
    "url_title",
]
