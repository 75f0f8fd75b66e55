"""Weighted reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .limits import check_top_k


@dataclass(frozen=True)
class Weights:
    lexical: float
    vector: float


#: Weights beside a reranker, and without one.
WITH_RERANKER, WITHOUT_RERANKER = Weights(1.0, 1.0), Weights(0.2, 1.0)


def fuse(lexical: DataFrame, vector: DataFrame, weights: Weights, *, k: int = 60, top_k: int = 20) -> DataFrame:
    """(query_id, id, score, lexical_rank, vector_rank, rank) from two lists of (query_id, id, rank).

    Score is the sum of weight / (k + rank).  Ties keep the keyword list's
    order, then the vector list's.
    """
    if not isinstance(weights, Weights):
        raise ValueError("fuse needs weights for both lists")
    check_top_k(top_k)
    rows = lexical.select("query_id", "id", (weights.lexical / (k + F.col("rank"))).alias("part"), F.col("rank").alias("l"), F.lit(None).cast("int").alias("v")).unionByName(
        vector.select("query_id", "id", (weights.vector / (k + F.col("rank"))).alias("part"), F.lit(None).cast("int").alias("l"), F.col("rank").alias("v"))
    )
    summed = rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.min("l").alias("lexical_rank"), F.min("v").alias("vector_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"))
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def weight_sweep(lexical: DataFrame, vector: DataFrame, shares: list[float], *, k: int = 60, top_k: int = 20) -> DataFrame:
    """``fuse`` for each keyword weight against 1 for the vector list, in one plan, with ``share``."""
    tables = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    key = F.struct("share", "query_id").alias("query_id")
    both = [df.select("query_id", "id", "rank", tables) for df in (lexical, vector)]
    parts = both[0].select(key, "id", (F.col("share") / (k + F.col("rank"))).alias("part"), F.col("rank").alias("l"), F.lit(None).cast("int").alias("v")).unionByName(
        both[1].select(key, "id", (1.0 / (k + F.col("rank"))).alias("part"), F.lit(None).cast("int").alias("l"), F.col("rank").alias("v"))
    )
    summed = parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.min("l").alias("l"), F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("l"), F.asc_nulls_last("v"))
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return top.select("query_id.share", "query_id.query_id", "id", "score", "rank")
