"""Keyword search: postings, BM25 over a batch of queries, top-k per query.

A batch of queries is one plan.  The texts are tokenised in the JVM; only
terms that some query asks for leave the scan, because the query terms are
joined in before anything is grouped.  Query terms are broadcast when there
are at most ``BROADCAST_TERMS`` of them, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as words_of
from .limits import check_top_k

K1, B = 1.2, 0.75
BROADCAST_TERMS = 100_000
#: Distinct query terms that are given to the scan of stored postings as a filter.
PUSHED_TERMS = 256


def term_table(chunks: DataFrame, *, text: str = "search_text", stem: bool = False) -> DataFrame:
    """(namespace, id, words, length) of every chunk."""
    words = words_of(F.coalesce(F.col(text), F.lit("")))
    if stem:
        from .porter import stemmed

        words = stemmed(words)
    return chunks.select("namespace", "id", words.alias("words")).withColumn("length", F.size("words").cast("long"))


def postings(chunks: DataFrame, *, text: str = "search_text", stem: bool = False) -> DataFrame:
    """(namespace, id, term, tf, length): the inverted index."""
    table = term_table(chunks, text=text, stem=stem)
    return table.select("namespace", "id", "length", F.explode_outer("words").alias("term")).where("term is not null").groupBy("namespace", "id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_stats(chunks: DataFrame, *, text: str = "search_text", stem: bool = False, scope: str = "namespace") -> DataFrame:
    """Number of chunks and mean length over all chunks, per namespace or over the whole index."""
    table = term_table(chunks, text=text, stem=stem)
    agg = (F.count("*").alias("n_chunks"), F.avg("length").alias("avg_length"))
    if scope == "namespace":
        return table.groupBy("namespace").agg(*agg)
    return table.select("namespace").distinct().crossJoin(F.broadcast(table.agg(*agg)))


def lexical_search(chunks: DataFrame, queries: DataFrame, top_k: int, *, text: str = "search_text", stem: bool = False, scope: str = "namespace") -> DataFrame:
    """(query_id, namespace, id, score, rank) for ``queries(query_id, namespace, q)``.

    Query terms count once; only chunks that hold one are returned; ties go by id.
    """
    check_top_k(top_k)
    wanted, hint = _wanted(queries, stem)
    table = term_table(chunks, text=text, stem=stem)
    # explode_outer: a plain explode would have Spark test the size of the words first, and so split every text twice
    own = _asked_for(table.select("namespace", "id", "length", F.explode_outer("words").alias("term")), wanted, hint, scope)
    counted = own.groupBy("namespace", "term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return _scored(counted, corpus_stats(chunks, text=text, stem=stem, scope=scope), wanted, hint, scope, top_k)


def search_postings(posted: DataFrame, stats: DataFrame, queries: DataFrame, top_k: int, *, stem: bool = False, scope: str = "namespace") -> DataFrame:
    """``lexical_search`` over stored ``postings`` and (namespace, n_chunks, avg_length): no text is read.

    At most ``PUSHED_TERMS`` distinct query terms reach the scan as a filter.
    """
    check_top_k(top_k)
    wanted, hint = _wanted(queries, stem)
    terms = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if 0 < len(terms) <= PUSHED_TERMS:
        posted = posted.where(_any_of(sorted(terms)))
    counted = _asked_for(posted.select("namespace", "id", "length", "term", "tf"), wanted, hint, scope)
    return _scored(counted, stats, wanted, hint, scope, top_k)


def _any_of(terms: list[str]) -> Column:
    """A balanced tree of equalities: Parquet tests each against a row group's bounds, where a long IN becomes one range."""
    if len(terms) == 1:
        return F.col("term") == terms[0]
    half = len(terms) // 2
    return _any_of(terms[:half]) | _any_of(terms[half:])


def _wanted(queries: DataFrame, stem: bool):
    """Distinct (query_id, namespace, term), and how to join what is no larger."""
    asked = words_of(F.coalesce(F.col("q"), F.lit("")))
    if stem:
        from .porter import stemmed

        asked = stemmed(asked)
    wanted = queries.select("query_id", "namespace", F.explode(F.array_distinct(asked)).alias("term"))
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # bounds the vocabulary too
    return wanted, F.broadcast if few else (lambda df: df)


def _df_key(scope: str) -> list[str]:
    return ["namespace", "term"] if scope == "namespace" else ["term"]


def _asked_for(rows: DataFrame, wanted: DataFrame, hint, scope: str) -> DataFrame:
    """Rows of asked terms; over the whole index those of every namespace, as all of them count for df."""
    key = _df_key(scope)
    return rows.join(hint(wanted.select(*key).distinct()), key, "left_semi")


def _scored(counted: DataFrame, stats: DataFrame, wanted: DataFrame, hint, scope: str, top_k: int) -> DataFrame:
    key = _df_key(scope)
    # read of all columns of ``counted``, so that both uses share one scan and one exchange
    chunks_with = F.count_if((F.col("tf") > 0) & (F.col("length") >= 0)).alias("df")
    df = counted.groupBy(*key).agg(chunks_with)
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = counted.join(hint(df), key).join(F.broadcast(stats), "namespace").select("namespace", "term", "id", (idf * weight).alias("part"))
    hits = scored.join(hint(wanted), ["namespace", "term"]).groupBy("query_id", "namespace", "id").agg(F.sum("part").alias("score"))
    return ranked(hits, top_k)


def ranked(hits: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` hits of each query, rank from 1; ties go by id.  Spark prunes before the shuffle.

    Scores are rounded to nine decimals first: sums come in any order, and texts that are equal should tie.
    """
    hits = hits.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
