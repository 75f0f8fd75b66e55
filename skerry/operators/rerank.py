"""Reranking the head of a fused list with a pluggable pair scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def overlap_scorer(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
    """Share of the query's words that the text holds: a stand-in for a cross-encoder, with its interface."""
    out = []
    for q, t in zip(queries, texts):
        asked = set(re.findall(r"[^\W_]+", q.lower()))
        out.append(len(asked & set(re.findall(r"[^\W_]+", t.lower()))) / max(1, len(asked)))
    return out


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = overlap_scorer, *, depth: int = 20, top_k: int = 20) -> DataFrame:
    """(query_id, id, score, rank): the first ``depth`` hits by the scorer's score of (query, text)."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(list(scorer(q.tolist(), t.tolist())), dtype=float)

    head = hits.where(F.col("rank") <= depth).select("query_id", "id")
    pairs = head.join(queries.select("query_id", "q"), "query_id").join(texts.select("id", "text"), "id")
    return ranked(pairs.select("query_id", "id", scored(F.coalesce("q", F.lit("")), F.coalesce("text", F.lit(""))).alias("score")), top_k)
