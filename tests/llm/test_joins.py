"""Joins and searches against brute force, with parameters that reach every branch."""

import random

import numpy as np
import pytest

from skerry.llm.components import components
from skerry.llm.embedding_dedup import near_duplicates
from skerry.llm.ngram_join import PrefixTree, jaccard_components
from skerry.llm.substring_dedup import dedup_substrings
from tests.conftest import SF
from tests.llm import brute


def copies(seed=5):
    """Copies, near copies around shared bases, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("rstu")
    passage = " ".join(word() for _ in range(45))
    rows, base = [], [[word() for _ in range(rng.randint(2, 90))] for _ in range(12)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words[rng.randrange(len(words))] = word()
        if i % 9 == 0:
            words[rng.randrange(len(words)) : 0] = passage.split()
        rows.append((i * 3 % 160, rng.choice([" ", "\n"]).join(words)))
    return [*rows, (500, ""), (501, None), (502, "one")]


@pytest.mark.parametrize("words,percent,block", [(3, 90, 128), (5, 80, 8), (2, 50, 3), (3, 30, 2)])
def test_jaccard(spark, words, percent, block):
    rows = copies()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(rows, words, percent)


def test_texts_that_only_share_a_passage_are_dropped_before_they_are_sent(spark, monkeypatch):
    """5,000 short texts around one passage, none of which link: what is sent to blocks follows the texts, not their pairs."""
    from skerry.llm import ngram_join

    sent = {}

    def noted(df, name):
        out = written(df, name)
        if name in ("members", "probed", "links"):
            sent[name] = out.count()
        return out

    written = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", noted)
    passage = " ".join(f"p{i}" for i in range(52))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{j}" for j in range(9))) for i in range(5000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80)
    assert got.where("doc_id <> component_id").count() == 0 and got.count() == 5000
    assert sent["members"] <= 5000 and "probed" not in sent


def test_large_buckets_of_two_kinds_are_probed(spark):
    """Two families of near copies that share a passage and do not link with each other, in buckets of many blocks."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [f"{'ab'[i % 2]}{j}" for j in range(30)]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(30)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(passage + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df, words=3, percent=80, block=16, probes=32).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(rows, 3, 80)


def test_prefix_tree_finds_exactly_the_links():
    rng = random.Random(1)
    sets = [tuple(sorted(rng.sample(range(120), rng.randint(1, 60)))) for _ in range(60)]
    sets += [tuple(sorted({*s[: len(s) * 9 // 10], rng.randrange(200, 300)})) for s in sets] + sets[:5]
    for percent in (30, 80, 90):
        tree = PrefixTree(percent)
        for i, s in enumerate(sets):
            want = {j for j in range(i) if 100 * len({*s} & {*sets[j]}) >= percent * len({*s} | {*sets[j]})}
            assert set(tree.links(s, lambda m: False)) == want
            tree.add(s)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = brute.groups({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i != c}


@pytest.mark.parametrize("window,seed,hot_least", [(35, 8, 64), (12, 4, 2), (6, 2, 1000)])
def test_substring_dedup(spark, window, seed, hot_least):
    rows = [*copies(), (900, "z y " * 60), (901, "q " * 50), (902, "z y " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_substrings(df, window=window, seed=seed, hot_least=hot_least)
    assert sorted(map(tuple, got.collect())) == sorted(brute.substring_dedup(rows, window))


@pytest.mark.parametrize("options", [{}, {"cosine": 0.4, "cell_rows": 4, "block": 16}, {"cosine": 0.5, "cell_rows": 20, "block": 4}])
def test_embeddings_reach_the_recall_asked_for(spark, options):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v = np.array(rows["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = (v @ v.T >= options.get("cosine", 0.93)) & (rows["label"].to_numpy()[:, None] == rows["label"].to_numpy()) & ~np.eye(len(v), dtype=bool)
    got = near_duplicates(spark.createDataFrame(rows), **options).toPandas().set_index("vec_id")["n_links"]
    found, real = got.sum(), link.sum()
    assert found <= real and found >= 0.9 * real
    assert (got.reindex(rows["vec_id"]).to_numpy() <= link.sum(1)).all()
