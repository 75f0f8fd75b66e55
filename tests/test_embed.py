import pytest

from skerry.operators.embed import Embedder, HashingBackend, recipe_of
from skerry.operators.evaluate import first_relevant, missed, missing_evidence, score_table


class Lengths:
    """Vector (length of the text, 1, 2); counts words."""

    def embed(self, texts):
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    def count(self, text):
        return len(text.split())


class Short(Lengths):
    def embed(self, texts):
        return super().embed(texts)[1:]


def test_batches_prefixes_and_progress(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 50)] + [(50, None)], "id long, text string").repartition(3)
    done = spark.sparkContext.accumulator(0)
    got = {r["id"]: r["embedding"] for r in Embedder(Lengths, "intfloat/e5-small", batch=4).embed_column(rows, "text", progress=done).collect()}
    prefix = len("passage: ")
    assert all(got[i] == [prefix + (i if i < 50 else 0), 1.0, 2.0] for i in got) and len(got) == 50 and done.value == 50


def test_queries_counts_and_width():
    e = Embedder(Lengths, "intfloat/e5-small")
    assert e.embed_query("ab")[0] == len("query: ab") and e.count_tokens("a b") == 3 and e.probe() == 3
    assert recipe_of("unknown").query == "" and Embedder().probe() == HashingBackend().width


def test_wrong_counts_are_refused():
    with pytest.raises(ValueError):
        Embedder(Short).embed_query("x")
    with pytest.raises(ValueError):
        Embedder(Short).probe()


def test_scores(spark):
    questions = spark.createDataFrame([("a", "exact", ["red fox"]), ("b", "exact", ["blue"]), ("c", "mixed", ["nowhere"]), ("d", "none", None)], "id string, type string, evidence array<string>")
    hits = spark.createDataFrame([("a", 1, "no"), ("a", 2, "The **Red**  fox"), ("b", 1, "blue sky"), ("c", 1, "else"), ("b", 11, "blue")], "query_id string, rank int, text string")
    ranks = first_relevant(questions, hits)
    assert {r["id"]: r["first_rank"] for r in ranks.collect()} == {"a": 2, "b": 1, "c": None, "d": None}
    total = score_table(ranks).where("type is null").first()
    assert (total["questions"], total["hit_1"], total["hit_5"], total["mrr"]) == (4, 0.25, 0.5, 0.375)
    assert missed(ranks).first()["missed"] == ["c", "d"]
    assert [r["phrase"] for r in missing_evidence(questions, hits).collect()] == ["nowhere"]
