"""Every operator and stage on awkward tables: nulls, empty and very long texts, repeated rows, nothing at all, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skerry.llm.chat_format import format_conversations, read_back
from skerry.llm.decontaminate import decontaminate, find_contamination
from skerry.llm.embedding_dedup import near_duplicates
from skerry.llm.ngram_join import jaccard_components, keep_one
from skerry.llm.packing import pack
from skerry.llm.pii import find_personal_data, redact_personal_data
from skerry.llm.quality import keep_quality, score_quality, train_quality
from skerry.llm.substring_dedup import dedup_substrings
from skerry.llm.toxicity import score_toxicity, train_toxicity
from skerry.llm.url_filter import Rule, judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (6, "x" * 200_000), (7, "same words here " * 20), (7, "same words here " * 20), (None, "no id here at all"), (None, None), (8, "é ü 😀 mixed \x00 text"), (9, "a " * 3000)]
    rows = [(i, t, None, "src0", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "spans", "score", "rank", "items", "prefix", "places", "text_hash", "__nth", "__gone", "gone", "n")})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "same words here same"), (2, None), (3, ""), (None, "no id")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (4, 6, 7, 8, 9)] + [(None, 1, 1), (1, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


def operators(spark, benchmark, labels):
    return {
        "op1": lambda d: jaccard_components(d, words=3, percent=90),
        "op2": lambda d: pack(d, TOKENIZER),
        "op3": lambda d: find_contamination(d, benchmark),
        "op4": lambda d: score_quality(d, train_quality(d, labels, updates=50)),
        "op5": find_personal_data,
        "op6": dedup_substrings,
        "op7": lambda d: score_toxicity(d, train_toxicity(d, labels, steps=5)),
        "keep_quality": lambda d: keep_quality(d, train_quality(d, labels, updates=50)),
        "keep_one": keep_one,
        "decontaminate": lambda d: decontaminate(d, benchmark),
        "redact": redact_personal_data,
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "keep_quality", "keep_one", "decontaminate", "redact"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, benchmark, labels, name):
    got = operators(spark, benchmark, labels)[name](awkward).collect()
    if name in ("op1", "op3", "op4", "op5", "op6", "op7", "redact"):
        assert len(got) == awkward.count()
    if name == "op1":
        by_id = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
        assert by_id[(4, 977)] == by_id[(5, 977)] == 4 and by_id[(2, 0)] == 2 and by_id[(1, 0)] == 1
    if name == "op2":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in awkward.collect()}
        assert all(r["length"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    if name == "op6":
        assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (4, 5, 7, 9)} == {4: 60_000, 5: 60_000, 7: 60, 9: 3000}
    if name in ("op4", "op7"):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "keep_one":
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8, 9]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, awkward, benchmark, labels, name):
    none = operators(spark, benchmark.limit(0), labels.limit(0))[name]
    out = none(awkward.limit(0))
    assert out.count() == 0 and len(out.columns) > 0
    assert none(awkward.where("doc_id < 4")).count() == 3 if name != "op2" else none(awkward.where("doc_id < 4")).count() == 3


@pytest.mark.parametrize("name", ["keep_quality", "keep_one", "decontaminate", "redact"])
def test_stages_keep_the_columns(spark, awkward, benchmark, labels, name):
    out = operators(spark, benchmark, labels)[name](awkward)
    assert out.dtypes == awkward.dtypes
    assert all(r["spans"] == "clash" for r in out.collect())


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [], 1), (None, [1.0, 0.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("rep", "cell", "n", "node")})
    got = {}
    for r in near_duplicates(df).collect():
        got.setdefault(r["vec_id"], (r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, False)
    assert near_duplicates(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, None, "<turn user>\nx\n</turn>\n"), (None, None, "user", "\\l"), (3, 0, "ro>le\n<", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("rows", "segments", "machine")})
    out = format_conversations(df)
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read_back(out).collect()}
    assert turns == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], 2: [("", "<turn user>\nx\n</turn>\n")], None: [("user", "\\l")], 3: [("ro>le\n<", "t")]}
    assert {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in out.collect()}[1] == (False, 2)
    assert format_conversations(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.ORG/es/x?y"), (4, "http://example.org"), (5, "x://a.b/c://d"), (6, "http://org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("k") for c in ("host", "path", "keys", "best", "key", "verdict", "__keys", "__best", "page", "judged")})
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block")]
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules).orderBy("page_id", "host").collect()]
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got and (3, "", "", None, "allow") in got
    assert (4, "www.example.org", "/es/x", "example.org/es/", "block") in got and (4, "example.org", "", None, "allow") in got
    assert (5, "a.b", "/c://d", None, "allow") in got and (6, "org", "/", "org/", "allow") in got
    assert judge_urls(df, []).count() == 7 and judge_urls(df.limit(0), rules).count() == 0
