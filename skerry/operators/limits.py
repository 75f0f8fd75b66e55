"""Argument checks that come before any data is touched."""

from __future__ import annotations

import math
from collections.abc import Sequence

#: Most hits of one search.
MAX_TOP_K = 4096


def check_top_k(top_k: int) -> None:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 0:
        raise ValueError(f"top_k must be a whole number and not negative, got {top_k}")
    if top_k > MAX_TOP_K:
        raise ValueError(f"top_k is limited to {MAX_TOP_K}, got {top_k}")


def check_query_vector(vector: Sequence[float], width: int | None = None) -> None:
    if not len(vector):
        raise ValueError("cannot search with an empty vector")
    if not all(math.isfinite(x) for x in vector):
        raise ValueError("cannot search with a non-finite vector")
    if not any(x != 0 for x in vector):
        raise ValueError("cannot search with a zero vector")
    if width is not None and len(vector) != width:
        raise ValueError(f"the index holds vectors of width {width}, the query has {len(vector)}")
