"""The smallest update that brings an index level with its source, as joins on fingerprints.

Unchanged documents leave at the first join, before anything is parsed or
chunked.  Documents missing from a read that had failures are held, never
deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHUNK_COLUMNS


@dataclass(frozen=True)
class UpdatePlan:
    """``embed`` and ``restate`` hold chunks, ``keep`` and ``remove`` chunk ids, ``summary`` one row of five counters."""

    embed: DataFrame
    restate: DataFrame
    keep: DataFrame
    remove: DataFrame
    removed_documents: DataFrame
    indexed_documents: DataFrame
    summary: DataFrame


def classify(loaded: DataFrame, indexed: DataFrame, held_chunks: DataFrame, *, complete: bool) -> DataFrame:
    """(doc_id, content_hash, state) of every document on either side.

    ``loaded(id, content_hash)``; ``indexed(doc_id, content_hash)``;
    ``held_chunks(doc_id, chunk_ids)``, where a document with no chunks has an
    empty array and one without a chunk record has no row.  A document is
    unchanged only with an equal hash and a chunk record.
    """
    first = Window.partitionBy("id").orderBy("content_hash")
    own = loaded.select("id", "content_hash").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("id").alias("doc_id"), F.col("content_hash").alias("new_hash"))
    known = indexed.select("doc_id", F.col("content_hash").alias("old_hash")).join(held_chunks.select("doc_id", F.lit(True).alias("recorded")), "doc_id", "full_outer")
    both = own.join(known, "doc_id", "full_outer")
    state = (
        F.when(F.col("new_hash").isNull(), F.lit("deleted" if complete else "held"))
        .when((F.col("new_hash") == F.col("old_hash")) & F.coalesce("recorded", F.lit(False)), "unchanged")
        .when(F.col("old_hash").isNull(), "added")
        .otherwise("updated")
    )
    return both.select("doc_id", F.col("new_hash").alias("content_hash"), state.alias("state"))


def summarize(states: DataFrame) -> DataFrame:
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "updated", "unchanged", "deleted", "held")])


def plan_update(loaded: DataFrame, failures: DataFrame, indexed: DataFrame, held_chunks: DataFrame, chunk_of: Callable[[DataFrame], DataFrame]) -> UpdatePlan:
    """Plan one run.  ``chunk_of`` maps documents to chunks and only ever sees those that changed."""
    states = classify(loaded, indexed, held_chunks, complete=failures.isEmpty())
    changed = states.where(F.col("state").isin("added", "updated"))
    first = Window.partitionBy("id").orderBy("content_hash")
    documents = loaded.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    fresh = chunk_of(documents.join(changed.select(F.col("doc_id").alias("id")), "id", "left_semi")).select(*CHUNK_COLUMNS)
    held = held_chunks.select("doc_id", F.explode("chunk_ids").alias("chunk_id"))
    key = (fresh["doc_id"] == held["doc_id"]) & (fresh["id"] == held["chunk_id"])
    stale = held.join(changed.select("doc_id"), "doc_id", "left_semi").join(fresh.select("doc_id", F.col("id").alias("chunk_id")), ["doc_id", "chunk_id"], "left_anti")
    gone = states.where("state = 'deleted'").select("doc_id")
    stay = states.where(F.col("state").isin("unchanged", "held")).select("doc_id")
    return UpdatePlan(
        embed=fresh.join(held, key, "left_anti"),
        restate=fresh.join(held, key, "left_semi"),
        keep=held.join(stay, "doc_id", "left_semi").select("chunk_id"),
        remove=stale.unionByName(held.join(gone, "doc_id", "left_semi")).select("chunk_id"),
        removed_documents=gone,
        indexed_documents=changed.select("doc_id", "content_hash"),
        summary=summarize(states),
    )
