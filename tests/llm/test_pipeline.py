"""The pipeline's stages, each on what the stage before kept, against plain Python."""

import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from skerry.llm.common import table, written
from skerry.llm.pii import all_spans, trained
from skerry.llm.quality import score_quality, train_quality
from tests.conftest import SF
from tests.llm import brute


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    before = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        rows = [r.asDict() for r in out.collect()]
        if name == "quality":
            scores = {r["doc_id"]: r["score"] for r in score_quality(docs, train_quality(docs, table(spark, SF, "labels"))).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, s in scores.items() if s >= 0.3} and 0 < len(rows) < len(before)
        if name == "near_duplicates":
            component = brute.jaccard([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in rows} == {i for i, (n, c) in component.items() if i == c or not n} and len(rows) < len(before)
        if name == "benchmark":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            found = brute.contamination([(r["doc_id"], r["text"]) for r in before], items, 10)
            assert {r["doc_id"] for r in rows} == {i for i, (n, hit, _) in found.items() if hit <= n / 2}
            assert all(len(brute.bench_words(r["text"])) == found[r["doc_id"]][0] - found[r["doc_id"]][1] for r in rows) and any(f[1] for f in found.values())
        if name == "personal_data":
            crf, old = trained(), {r["doc_id"]: r["text"] for r in before}
            assert [r["doc_id"] for r in rows if r["text"] != old[r["doc_id"]]]
            for r in rows:
                spans = all_spans([old[r["doc_id"]]], crf)[0][1]
                assert (r["text"] != old[r["doc_id"]]) == bool(spans) and all(old[r["doc_id"]][a:b] not in r["text"] for k, a, b in spans if k == "email")
        if name == "packing":
            tokenizer, by_doc, by_bin = Tokenizer.from_file(corpus_pipeline.TOKENIZER), {}, {}
            for r in rows:
                by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
                by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for r in before:
                ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
                want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
                assert sorted(by_doc.pop(r["doc_id"])) == want
            assert not by_doc
            for own in by_bin.values():
                ends = [0, *(a + n for a, n in sorted(own))]
                assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
        else:
            assert out.columns == docs.columns
        docs, before = out, rows
