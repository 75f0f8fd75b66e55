"""Scores of ranked lists against questions, and cut-offs for refusing to answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_evidence


def holds_evidence(text: Column, evidence: Column) -> Column:
    """Whether the normalised text holds any of the evidence phrases."""
    return F.coalesce(F.exists(evidence, lambda e: F.contains(text, e)), F.lit(False))


def missing_evidence(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, phrase) of evidence that no text holds: a check of the questions, or with chunks as texts of the chunker.

    Phrases are a stated query set; each text is read once and names the
    phrases it holds.
    """
    phrases = questions.select("id", F.explode("evidence").alias("phrase")).distinct()
    held = texts.select(normalize_evidence(F.coalesce("text", F.lit(""))).alias("text")).join(F.broadcast(phrases.select("phrase").distinct()), F.contains("text", F.col("phrase")))
    return phrases.join(held.select("phrase").distinct(), "phrase", "left_anti").select("id", "phrase")


def first_relevant(questions: DataFrame, hits: DataFrame, *, depth: int = 10) -> DataFrame:
    """(id, type, first_rank): the best rank up to ``depth`` whose text holds evidence, null if none.

    ``hits(query_id, rank, text)``; ``questions(id, type, evidence)``.
    """
    joined = questions.join(hits.where(F.col("rank") <= depth), F.col("id") == F.col("query_id"), "left")
    relevant = F.when(holds_evidence(normalize_evidence(F.coalesce("text", F.lit(""))), F.col("evidence")), F.col("rank"))
    return joined.groupBy("id", "type").agg(F.min(relevant).alias("first_rank"))


def score_table(ranks: DataFrame) -> DataFrame:
    """hit@1, hit@5 and MRR by type and over all (type null): one rollup over (type, first_rank)."""
    r = F.col("first_rank")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return ranks.rollup("type").agg(
        F.count("*").alias("questions"), share(r <= 1).alias("hit_1"), share(r <= 5).alias("hit_5"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr")
    )


def missed(ranks: DataFrame, *, depth: int = 5) -> DataFrame:
    """Ids of the questions without a relevant hit up to ``depth``, sorted, in one row."""
    lost = F.col("first_rank").isNull() | (F.col("first_rank") > depth)
    return ranks.agg(F.array_sort(F.collect_list(F.when(lost, F.col("id")))).alias("missed"))


def running_totals(rows: DataFrame, value: str, *counts: str, buckets: int = 256) -> DataFrame:
    """``rows`` (one a value) with ``{count}_before``: each count summed over all smaller values.

    Values are dealt to buckets by approximate quantiles; sums run inside each
    bucket and over the buckets' totals, so no task ever holds all values.
    """
    cuts = rows.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    dealt = rows.withColumn("__bucket", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    earlier = Window.unboundedPreceding, -1
    totals = dealt.groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in counts])
    over = Window.orderBy("__bucket").rowsBetween(*earlier)  # at most ``buckets`` rows
    base = totals.select("__bucket", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"__{c}") for c in counts])
    inside = Window.partitionBy("__bucket").orderBy(value).rowsBetween(*earlier)
    before = {f"{c}_before": F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts}
    return dealt.join(F.broadcast(base), "__bucket").withColumns(before).drop("__bucket", *[f"__{c}" for c in counts])


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """The value at index floor(share * n) of the sorted values, as one row ``value``; not interpolated."""
    by_value = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    at = F.least(F.floor(F.lit(share) * F.col("all")), F.col("all") - 1)
    counted = running_totals(by_value, "value", "n").crossJoin(F.broadcast(by_value.agg(F.sum("n").alias("all"))))
    return counted.where((F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))).select("value")


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """The cut-off on ``score`` with the best mean of kept answerable and refused unanswerable shares; the least on ties.

    ``scores(score, answerable)``.  Candidates are the distinct scores; counts
    on either side come from running sums over the distinct scores.
    """
    by_score = scores.groupBy("score").agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    total = scores.agg(F.count_if("answerable").alias("all_yes"), F.count_if(~F.col("answerable")).alias("all_no"))
    swept = running_totals(by_score, "score", "yes", "no").crossJoin(F.broadcast(total))
    kept = F.coalesce((F.col("all_yes") - F.col("yes_before")) / F.nullif("all_yes", F.lit(0)), F.lit(0.0))
    refused = F.coalesce(F.col("no_before") / F.nullif("all_no", F.lit(0)), F.lit(0.0))
    rated = swept.select("score", kept.alias("kept"), refused.alias("refused"), ((kept + refused) / 2).alias("balanced"))
    return rated.orderBy(F.desc("balanced"), F.asc("score")).limit(1)


def keep_cutoff(scores: DataFrame, *, lose: float = 0.05) -> DataFrame:
    """The cut-off that keeps all but ``lose`` of the answerable, and the share of unanswerable it refuses."""
    cut = nearest_rank(scores.where("answerable"), "score", lose).select(F.col("value").alias("cutoff"))
    refused = F.avg(F.when(F.col("score") < F.col("cutoff"), 1.0).otherwise(0.0))
    return scores.where(~F.col("answerable")).crossJoin(F.broadcast(cut)).groupBy("cutoff").agg(refused.alias("refused"))
