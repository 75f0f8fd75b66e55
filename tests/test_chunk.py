import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.operators.chunk import ChunkOptions, HeaderTooLong, chunk_document, chunk_documents, fixed_windows, quarter_of_characters
from skerry.operators.markdown import parse_markdown
from skerry.operators.split import sentences, split


def words(text):
    return len(text.split())


def chunks_of(source, title="Doc", **options):
    parsed = parse_markdown(source)
    doc = {"id": "d" * 16, "namespace": "n", "uri": "u", "title": title}
    return parsed, chunk_document(doc, parsed["blocks"], parsed["title"] or title, ChunkOptions(**options))


@given(st.text(alphabet="ab .?!\n", max_size=300), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_split_only_cuts_and_stays_in_budget(text, budget):
    parts = split(text, budget, quarter_of_characters)
    at = 0
    for p in parts:
        at = text.index(p, at) + len(p)
        assert quarter_of_characters(p) <= budget
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    assert "".join(sentences(text)) == text


def test_split_prefers_sentences_and_keeps_urls():
    assert split("One two. Three four. Five six.", 4, words) == ["One two. Three four.", "Five six."]
    assert "https://a.b/c?id=1&x=2" in split("Go to https://a.b/c?id=1&x=2 now. Then stop here please.", 4, words)[0]
    assert all(len(p) <= 40 for p in split("x" * 400, 10, quarter_of_characters))


def test_sections_never_mix_and_ids_ignore_position():
    _, first = chunks_of("# T\n\n## A\n\none\n\n## B\n\ntwo")
    _, moved = chunks_of("# T\n\n## New\n\nzero\n\n## A\n\none\n\n## B\n\ntwo")
    assert [c["heading_path"] for c in first] == [["A"], ["B"]]
    assert {c["id"] for c in first} < {c["id"] for c in moved}


def test_spans_tokens_and_duplicates():
    parsed, got = chunks_of("para one\n\npara two\n\n## S\n\nsame\n\n## S\n\nsame", max_tokens=20)
    assert parsed["text"][got[0]["char_start"] : got[0]["char_end"]] == got[0]["text"] == "para one\n\npara two"
    assert len(got) == 2 and len({c["hash"] for c in got}) == 2
    assert all(c["id"] == "d" * 16 + "-" + c["hash"][:12] for c in got)


def test_budget_includes_the_header():
    _, got = chunks_of("\n\n".join(f"Sentence number {i} of the text." for i in range(200)), title="A title", max_tokens=64)
    assert all(c["tokens"] <= 64 for c in got)
    with pytest.raises(HeaderTooLong):
        chunks_of("text", title="t" * 400, max_tokens=50)


def test_a_document_that_cannot_be_chunked_is_a_failure_row(spark):
    from skerry.operators.parse import parse_documents

    docs = spark.createDataFrame([("1", "n", "a.md", "ok", "text"), ("2", "n", "b.md", "t" * 2000, "text")], "id string, namespace string, uri string, title string, text string")
    chunks, failures = chunk_documents(parse_documents(docs))
    assert [c["uri"] for c in chunks.collect()] == ["a.md"]
    assert [f["uri"] for f in failures.collect()] == ["b.md"]


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "id long, text string")
    assert [tuple(r) for r in fixed_windows(docs, 2).orderBy("id", "ord").collect()] == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e")]
