import math

import pytest
from pyspark.sql import functions as F

from skerry.operators.evaluate import keep_cutoff, nearest_rank, running_totals, threshold_sweep
from skerry.operators.fusion import WITH_RERANKER, WITHOUT_RERANKER, Weights, fuse
from skerry.operators.lexical import lexical_search
from skerry.operators.limits import check_query_vector, check_top_k
from skerry.operators.porter import stem
from skerry.operators.rerank import rerank
from skerry.operators.vector import vector_search


def chunks(spark, *texts, namespace="n"):
    return spark.createDataFrame([(namespace, f"c{i}", t) for i, t in enumerate(texts)], "namespace string, id string, search_text string")


def ask(spark, q, namespace="n"):
    return spark.createDataFrame([("q", namespace, q)], "query_id string, namespace string, q string")


def test_bm25_prefers_rare_words_and_only_returns_matches(spark):
    got = lexical_search(chunks(spark, "the policy covers chargebacks", "the the policy", "the policy of the house", "none here"), ask(spark, "the policy chargebacks"), 10).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])][0] == "c0" and len(got) == 3
    n, df, tf, length, avg = 4, 1, 1, 4, 14 / 4
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    rare = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    only = lexical_search(chunks(spark, "the policy covers chargebacks", "the the policy", "the policy of the house", "none here"), ask(spark, "chargebacks"), 1).first()
    assert only["score"] == pytest.approx(rare)


@pytest.mark.parametrize("q", ['refund "', "refund*", "refund AND (", "refund^2", "REFUND"])
def test_operators_are_text(spark, q):
    assert lexical_search(chunks(spark, "a refund", "other"), ask(spark, q), 5).first()["id"] == "c0"


def test_namespaces_do_not_see_each_other(spark):
    both = chunks(spark, "apple").unionByName(chunks(spark, "apple apple", namespace="m"))
    assert [r["namespace"] for r in lexical_search(both, ask(spark, "apple"), 5).collect()] == ["n"]


def test_multi_script_ties_and_empty_queries(spark):
    table = chunks(spark, "रिफंड 30 दिन में", "same words", "same words", None)
    assert lexical_search(table, ask(spark, "30"), 5).first()["id"] == "c0"
    assert [r["id"] for r in lexical_search(table, ask(spark, "same"), 5).orderBy("rank").collect()] == ["c1", "c2"]
    assert lexical_search(table, ask(spark, "?!"), 5).count() == 0
    assert lexical_search(table, ask(spark, "same"), 0).count() == 0


def test_stemming(spark):
    assert lexical_search(chunks(spark, "refunding customers"), ask(spark, "refunds"), 5, stem=True).count() == 1
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "sky", "rate")] == ["caress", "poni", "relat", "hop", "happi", "sky", "rate"]


def test_vector_search_is_cosine_within_the_namespace(spark):
    rows = spark.createDataFrame([("n", "a", [1.0, 0.0]), ("n", "b", [0.0, 5.0]), ("n", "c", [1.0, 1.0]), ("m", "d", [1.0, 0.0])], "namespace string, id string, embedding array<float>")
    asked = spark.createDataFrame([("q", "n", [2.0, 0.0])], "query_id string, namespace string, vector array<float>")
    got = vector_search(rows, asked, 2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 4)) for r in got] == [("a", 1.0), ("c", 0.7071)]
    assert vector_search(rows, asked.limit(0), 2).count() == 0


@pytest.mark.parametrize("bad", [-1, 2.5, float("nan"), 4097, True])
def test_top_k_is_checked_first(bad):
    with pytest.raises(ValueError):
        check_top_k(bad)


@pytest.mark.parametrize("bad", [[], [0.0, 0.0], [float("nan")], [float("inf"), 1.0]])
def test_query_vectors_are_checked(bad):
    with pytest.raises(ValueError):
        check_query_vector(bad)


def ranks(spark, *ids):
    return spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, id string, rank int")


def test_fusion_scores_ties_and_weights(spark):
    got = fuse(ranks(spark, "a", "b"), ranks(spark, "b", "c"), WITH_RERANKER).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"] and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert fuse(ranks(spark, "noise", "answer"), ranks(spark, "answer", "noise"), WITH_RERANKER).orderBy("rank").first()["id"] == "noise"
    assert fuse(ranks(spark, "noise", "answer"), ranks(spark, "answer", "noise"), WITHOUT_RERANKER).orderBy("rank").first()["id"] == "answer"
    assert fuse(ranks(spark, "a").limit(0), ranks(spark, "x", "y"), Weights(1, 1), top_k=1).first()["id"] == "x"
    with pytest.raises(ValueError):
        fuse(ranks(spark, "a"), ranks(spark, "b"), None)


def test_rerank_orders_the_head(spark):
    hits = ranks(spark, "a", "b", "c")
    texts = spark.createDataFrame([("a", "nothing"), ("b", "red fox"), ("c", "red")], "id string, text string")
    got = rerank(hits, ask(spark, "red fox").select("query_id", "q"), texts, depth=2).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a"]


def test_running_totals_and_quantiles_agree_with_sorting(spark):
    values = [(i * 37) % 101 / 10 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for share in (0.0, 0.05, 0.5, 0.9, 1.0):
        assert nearest_rank(df, "x", share).first()["value"] == sorted(values)[min(499, int(share * 500))]
    one = running_totals(df.groupBy("x").agg(F.count("*").alias("n")), "x", "n", buckets=7)
    assert all(r["n_before"] == sum(v < r["x"] for v in values) for r in one.collect())
    assert nearest_rank(df.limit(0), "x", 0.5).count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, True), (0.4, False), (0.5, True)], "score double, answerable boolean")
    best = threshold_sweep(df).first()
    assert (best["score"], best["balanced"]) == (0.3, pytest.approx((1 + 2 / 3) / 2))
    assert keep_cutoff(df).first()["cutoff"] == 0.3


def test_index_scope_counts_chunks_of_every_namespace(spark):
    import math

    rows = [("n", "a", "net rope"), ("m", "b", "net net"), ("m", "c", "lamp")]
    df = spark.createDataFrame(rows, "namespace string, id string, search_text string")
    hit = lexical_search(df, spark.createDataFrame([("q", "n", "net")], "query_id string, namespace string, q string"), 5, scope="index").collect()
    length, mean = 2, 5 / 3
    want = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    assert [r["id"] for r in hit] == ["a"] and abs(hit[0]["score"] - want) < 1e-8
