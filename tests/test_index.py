import pytest

from skerry.operators.store import MemoryStore, ParquetStore, StoreWrite
from skerry.operators.sync import plan_update
from skerry.plans.index import index_documents, search
from skerry.schema import CHUNK, DOCUMENT, FAILURE, STORED_CHUNK
from skerry.streaming import index_batch, index_stream


def chunk(cid, vector=None, doc="doc-1", ns="acme", text="text", **extra):
    row = {"id": cid, "doc_id": doc, "namespace": ns, "uri": "u", "title": "Handbook", "heading_path": [], "text": text, "char_start": 0, "char_end": len(text or ""), "tokens": 1, "hash": "h" + cid} | extra
    return row | ({"embedding": vector} if vector is not None else {})


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(params=["parquet", "memory"])
def store(request, spark, tmp_path):
    return ParquetStore(spark, str(tmp_path / "s")) if request.param == "parquet" else MemoryStore(spark)


def write(store, **parts):
    spark = store.spark
    schemas = {"upsert": STORED_CHUNK, "restate": CHUNK, "remove_chunks": "chunk_id string", "remove_documents": "doc_id string", "documents": "doc_id string, content_hash string"}
    rows = {k: spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in v], schemas[k]) for k, v in parts.items()}
    store.apply("acme", StoreWrite(**rows))


def test_upsert_restate_remove(store):
    write(store, upsert=[chunk("a", [1.0, 0.0]), chunk("b", [0.0, 1.0]), chunk("c", [1.0, 1.0], doc="doc-2")], documents=[("doc-1", "x"), ("doc-2", "y"), ("empty", "z")])
    documents, held = store.snapshot("acme")
    assert {r["doc_id"]: r["chunk_ids"] for r in held.collect()} == {"doc-1": ["a", "b"], "doc-2": ["c"], "empty": []}
    write(store, upsert=[chunk("b", [1.0, 0.0], text="new")], restate=[chunk("a", text="moved", char_start=7)], remove_documents=[("doc-2",), ("none",)], remove_chunks=[("none",)])
    rows = {r["id"]: r for r in store.chunks("acme").collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["char_start"] == 7 and rows["a"]["embedding"] == [1.0, 0.0] and rows["b"]["text"] == "new"
    assert ids(store.documents("acme").select("doc_id")) == ["doc-1", "empty"]


@pytest.mark.parametrize("bad", [[0.0, 0.0], [float("nan"), 1.0], [], [1.0]])
def test_bad_vectors_change_nothing(store, bad):
    write(store, upsert=[chunk("a", [1.0, 0.0])])
    with pytest.raises(ValueError):
        write(store, upsert=[chunk("b", bad)])
    assert ids(store.chunks("acme").select("id")) == ["a"]


@pytest.mark.parametrize("field", ["id", "doc_id", "uri", "title", "text", "hash"])
def test_nul_is_refused(store, field):
    with pytest.raises(ValueError):
        write(store, upsert=[chunk("a", [1.0]) | {field: "x\x00y"}])


def test_other_refusals(store):
    with pytest.raises(ValueError):
        write(store, upsert=[chunk("a", [1.0], ns="other")])
    with pytest.raises(ValueError):
        write(store, restate=[chunk("never")])
    write(store, upsert=[chunk("a", [1.0, 0.0])])
    with pytest.raises(ValueError):
        write(store, restate=[chunk("a")], remove_chunks=[("a",)])
    write(store, upsert=[chunk("b", [1.0, 0.0, 0.0])], remove_chunks=[("a",)])  # nothing else survives, so the width may change
    assert len(store.chunks("acme").first()["embedding"]) == 3


def test_searches_reopen_and_lost_races(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    write(store, upsert=[chunk("a", [1.0, 0.0], text="refunds take days"), chunk("b", [0.0, 1.0], text="other")])
    again = ParquetStore(spark, str(tmp_path / "s"))
    q = spark.createDataFrame([("q", "acme", "refund", [1.0, 0.1])], "query_id string, namespace string, q string, vector array<float>")
    assert again.lexical_search(q, 5).first()["id"] == "a"
    assert [r["id"] for r in again.vector_search(q, 5).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        again.vector_search(q.selectExpr("query_id", "namespace", "array(1f) AS vector"), 5)
    stale = again._manifest()
    write(store, upsert=[chunk("c", [1.0, 1.0])])
    from dataclasses import replace

    with pytest.raises(RuntimeError):
        again._publish(replace(stale, number=stale.number + 1))
    assert ids(again.chunks("acme").select("id")) == ["a", "b", "c"]


@pytest.mark.parametrize("stem", [False, True])
@pytest.mark.parametrize("scope", ["namespace", "index"])
def test_stored_postings_score_as_the_texts_do(spark, tmp_path, stem, scope):
    """Same hits from postings, from texts (a store of other words reopened), and after an update; the asked terms reach the scan."""
    from skerry.operators.lexical import lexical_search

    store = ParquetStore(spark, str(tmp_path / "s"), stem=stem, scope=scope)
    write(store, upsert=[chunk("a", [1.0], text="refunds take days, refund days"), chunk("b", [1.0], text="other days"), chunk("x", [1.0], text="days")])
    write(store, remove_chunks=[("x",)], restate=[chunk("b", text="other refund")])
    other = spark.createDataFrame([tuple(chunk("c", [1.0], ns="beta", text="Days of refunds").values())], STORED_CHUNK)
    store.apply("beta", StoreWrite(upsert=other))
    store.apply("none", StoreWrite())
    q = spark.createDataFrame([("q", "acme", "refund days"), ("r", "beta", "DAYS"), ("s", "acme", ""), ("t", "none", "days")], "query_id string, namespace string, q string")
    texts = store.chunks("acme").unionByName(store.chunks("beta")).selectExpr("namespace", "id", "concat('Handbook ', text) AS search_text")
    want = sorted(map(tuple, lexical_search(texts, q, 5, stem=stem, scope=scope).collect()))
    found = store.lexical_search(q, 5)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 3
    assert "EqualTo(term,da" in found._jdf.queryExecution().toString()
    reopened = ParquetStore(spark, str(tmp_path / "s"), stem=not stem, scope=scope)
    assert sorted(map(tuple, reopened.lexical_search(q, 5).collect())) == sorted(map(tuple, lexical_search(texts, q, 5, stem=not stem, scope=scope).collect()))


def test_small_writes_add_small_segments(spark, tmp_path):
    """Random writes against a dict: rows, counters and postings agree, old segments stay, their number stays small."""
    import random

    rng, store, held, listed = random.Random(3), ParquetStore(spark, str(tmp_path / "s"), stem=False), {}, {}
    first = {f"c{i:03}": f"word{i % 7} net" for i in range(200)}
    write(store, upsert=[chunk(i, [1.0], doc=f"d{int(i[1:]) % 5}", text=t) for i, t in first.items()], documents=[(f"d{k}", "x") for k in range(5)])
    held |= {i: (f"d{int(i[1:]) % 5}", t) for i, t in first.items()}
    listed |= {f"d{k}": "x" for k in range(5)}
    base = store._segments("acme")[0]["folder"]
    for step in range(6):
        gone = set(rng.sample(sorted(held), 2)) if step % 2 else set()
        new = {f"n{step}": f"rope word{step}", rng.choice(sorted(set(held) - gone)): "upserted rope net"}
        moved = {i: f"moved net {step}" for i in rng.sample(sorted(set(held) - gone), 2)}
        dropped = {"d4"} if step == 5 else set()
        moved = {i: t for i, t in moved.items() if held[i][0] not in dropped}
        write(
            store, upsert=[chunk(i, [2.0], doc="d1", text=t) for i, t in new.items()], restate=[chunk(i, doc=held[i][0], text=t) for i, t in moved.items()],
            remove_chunks=[(i,) for i in gone], remove_documents=[(d,) for d in dropped], documents=[("d1", f"y{step}")],
        )
        held = {i: v for i, v in held.items() if i not in gone and v[0] not in dropped}
        held |= {i: (held[i][0], t) for i, t in moved.items()} | {i: ("d1", t) for i, t in new.items()}
        listed = {d: h for d, h in listed.items() if d not in dropped} | {"d1": f"y{step}"}
        own = store._manifest().namespaces["acme"]
        assert own["segments"][0]["folder"] == base or step == 5
        assert len(own["segments"]) <= 4
        assert (own["n_chunks"], own["n_words"]) == (len(held), sum(len(f"Handbook {t}".split()) for _, t in held.values()))
    assert {r["id"]: (r["doc_id"], r["text"]) for r in store.chunks("acme").collect()} == held
    assert dict(map(tuple, store.documents("acme").collect())) == listed
    want = sorted((i, w, f"Handbook {t}".lower().split().count(w)) for i, (_, t) in held.items() for w in set(f"Handbook {t}".lower().split()))
    assert sorted(map(tuple, store._postings(store._segments("acme")).select("id", "term", "tf").collect())) == want


def documents(spark, *rows):
    return spark.createDataFrame([(i, "acme", f"{i}.md", i, t, f"hash of {t}", {}, None) for i, t in rows], DOCUMENT)


def plan(spark, loaded, indexed, held, failed=False):
    def chunk_of(docs):
        return spark.createDataFrame([tuple(chunk(f"{d['id']}-{part}", doc=d["id"]).values()) for d in docs.collect() for part in d["text"].split()], CHUNK)

    failures = spark.createDataFrame([("x", "bad")] if failed else [], FAILURE)
    return plan_update(
        documents(spark, *loaded), failures, spark.createDataFrame(indexed, "doc_id string, content_hash string"), spark.createDataFrame(held, "doc_id string, chunk_ids array<string>"), chunk_of
    )


def test_edit_embeds_only_what_is_new(spark):
    got = plan(spark, [("a", "1 NEW 3"), ("b", "same"), ("b", "same")], [("a", "old"), ("b", "hash of same"), ("gone", "h")], [("a", ["a-1", "a-2", "a-3"]), ("b", ["b-same"]), ("gone", ["g-1"]), ("orphan", ["o-1"])])
    assert (ids(got.embed.select("id")), ids(got.restate.select("id"))) == (["a-NEW"], ["a-1", "a-3"])
    assert (ids(got.keep), ids(got.remove), ids(got.removed_documents)) == (["b-same"], ["a-2", "g-1", "o-1"], ["gone", "orphan"])
    assert got.summary.first().asDict() == {"added": 0, "updated": 1, "unchanged": 1, "deleted": 2, "held": 0}


def test_partial_read_deletes_nothing_and_a_missing_record_is_read_again(spark):
    got = plan(spark, [("a", "1")], [("a", "hash of 1"), ("gone", "h")], [("gone", ["g-1"])], failed=True)
    assert (ids(got.embed.select("id")), ids(got.keep), ids(got.remove)) == (["a-1"], ["g-1"], [])
    assert got.summary.first()["held"] == 1 and got.summary.first()["updated"] == 1
    empty = plan(spark, [("a", "1")], [("a", "hash of 1")], [("a", [])])
    assert empty.summary.first()["unchanged"] == 1


def test_sync_story(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], FAILURE)
    first = [("a", "# A\n\n## One\n\nalpha\n\n## Two\n\nbeta"), ("b", "gamma delta")]
    assert index_documents(store, "acme", documents(spark, *first), none)["added"] == 2
    assert index_documents(store, "acme", documents(spark, *first), none)["unchanged"] == 2
    before = {r["id"] for r in store.chunks("acme").collect()}
    edited = [("a", first[0][1].replace("beta", "changed")), first[1]]
    assert index_documents(store, "acme", documents(spark, *edited), none)["updated"] == 1
    assert len({r["id"] for r in store.chunks("acme").collect()} - before) == 1
    q = spark.createDataFrame([("q", "acme", "gamma")], "query_id string, namespace string, q string")
    assert search(store, q).orderBy("rank").first()["id"].startswith("b-")
    assert index_documents(store, "acme", documents(spark, edited[0]), none)["deleted"] == 1
    assert {r["doc_id"] for r in store.chunks("acme").collect()} == {"a"}


def test_stream_batches_never_delete_and_replay_is_harmless(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    assert index_batch(store, "acme", documents(spark, ("a", "x")))["added"] == 1
    assert index_batch(store, "acme", documents(spark, ("b", "y")))["held"] == 1
    documents(spark, ("c", "z")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCUMENT).parquet(str(tmp_path / "in"))
    index_stream(stream, store, "acme", str(tmp_path / "cp")).awaitTermination()
    assert {r["doc_id"] for r in store.chunks("acme").collect()} == {"a", "b", "c"}
