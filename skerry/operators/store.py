"""A tenant-partitioned index with atomic writes: chunks, vectors and keyword entries in segments.

A write adds one segment to its namespace: Parquet tables of the chunks it
brings (with vectors), of their postings in term order, of document rows, and
of the ids that it takes back from earlier segments.  Readers take the rows of
all segments less those taken back later, so a small update writes its own
rows and no others.  Segments whose sizes are within ``MERGE_FACTOR`` are
merged, newest first: a namespace has a number of segments that is logarithmic
in its rows, and a row is rewritten that often.

A write is published by creating the next manifest file; who creates it first
wins, and an unpublished segment is garbage nobody reads.  Readers look the
newest manifest up for every call, so all sessions see the same.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search_text
from ..functions import terms as words_of
from ..schema import CHUNK, CHUNK_COLUMNS, INDEXED_DOCUMENT, SCHEMA_VERSION, STORED_CHUNK
from .lexical import postings, search_postings
from .limits import check_query_vector, check_top_k
from .vector import vector_search


_POSTING = "id string, term string, tf long, length long"
_HELD = STORED_CHUNK + ", n_words long"
_GONE = "id string, n_words long"
#: A segment is merged with the one before while that one has at most so many times its rows.
MERGE_FACTOR = 2


@dataclass(frozen=True)
class StoreWrite:
    """``upsert`` has chunks with ``embedding``, ``restate`` chunks; the rest are ids and document rows.  None is empty."""

    upsert: DataFrame | None = None
    restate: DataFrame | None = None
    remove_chunks: DataFrame | None = None
    remove_documents: DataFrame | None = None
    documents: DataFrame | None = None


@dataclass(frozen=True)
class _Manifest:
    number: int = 0
    schema_version: int = SCHEMA_VERSION
    namespaces: dict[str, dict] = field(default_factory=dict)

    def width_beside(self, namespace: str) -> int | None:
        return next((n["width"] for name, n in self.namespaces.items() if name != namespace and n["width"]), None)


class ParquetStore:
    """Versioned Parquet under ``path`` (any file system Spark reads)."""

    stem, scope = True, "index"

    def __init__(self, spark: SparkSession, path: str, *, stem: bool | None = None, scope: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.stem = type(self).stem if stem is None else stem
        self.scope = scope or type(self).scope
        self._manifest()

    # -- manifest ---------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> _Manifest:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return _Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return _Manifest()
        for number in sorted(numbers, reverse=True):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{number:012d}.json"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if not text.endswith("\n"):  # still being written: the version before holds
                continue
            found = json.loads(text)
            if found["schema_version"] != SCHEMA_VERSION:
                raise ValueError(f"the index has schema version {found['schema_version']}, this library reads {SCHEMA_VERSION}")
            return _Manifest(number, found["schema_version"], found["namespaces"])
        return _Manifest()

    def _publish(self, manifest: _Manifest) -> None:
        jvm, fs = self._fs()
        text = json.dumps({"schema_version": manifest.schema_version, "namespaces": manifest.namespaces}) + "\n"
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{manifest.number:012d}.json")
        try:
            out = fs.create(final, False)  # exclusive: the file must not exist
        except Exception as e:
            raise RuntimeError("another write was published meanwhile; plan the update again") from e
        out.write(bytearray(text.encode()))
        out.close()

    # -- reads ------------------------------------------------------------

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _stored(self, segment: dict, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment['folder']}/{what}")

    def _live(self, segments: list[dict], what: str, schema: str, part=None) -> DataFrame:
        """Rows of ``what`` that no later segment takes back; ``part(segment)`` reads one segment.

        One anti join on the key, whatever the number of segments; Spark
        broadcasts the keys taken back where their measured size allows it.
        """
        part = part or (lambda segment: self._stored(segment, what, schema))
        key, gone_table, count, rows_of = ("doc_id", "gone_documents", "n_gone_documents", "n_documents") if what == "documents" else ("id", "gone_chunks", "n_gone", "n_rows")
        gone = None
        for at, segment in enumerate(segments):
            if at and segment[count]:
                own = self._stored(segment, gone_table, f"{key} string").select(F.col(key).alias("__gone"), F.lit(at).alias("__until"))
                gone = own if gone is None else gone.unionByName(own)
        rows = None
        for at, segment in enumerate(segments):
            if not segment[rows_of]:
                continue
            own = part(segment).withColumn("__at", F.lit(at))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self._none(schema)
        if gone is not None:
            latest = gone.groupBy("__gone").agg(F.max("__until").alias("__until"))
            rows = rows.join(latest, (F.col(key) == F.col("__gone")) & (F.col("__until") > F.col("__at")), "left_anti")
        return rows.drop("__at")

    def _segments(self, namespace: str) -> list[dict]:
        return self._manifest().namespaces.get(namespace, {}).get("segments", [])

    def chunks(self, namespace: str) -> DataFrame:
        return self._live(self._segments(namespace), "chunks", STORED_CHUNK)

    def documents(self, namespace: str) -> DataFrame:
        return self._live(self._segments(namespace), "documents", INDEXED_DOCUMENT)

    def snapshot(self, namespace: str) -> tuple[DataFrame, DataFrame]:
        """(doc_id, content_hash) and (doc_id, chunk_ids); a document without chunks has an empty array."""
        documents, chunks = self.documents(namespace), self.chunks(namespace)
        grouped = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("chunk_ids"))
        held = documents.select("doc_id").join(grouped, "doc_id", "full_outer").select("doc_id", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
        return documents, held

    def _searchable(self) -> DataFrame:
        out = None
        for own in self._manifest().namespaces.values():
            part = self._live(own["segments"], "chunks", STORED_CHUNK)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], STORED_CHUNK)

    def lexical_search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, namespace, id, score, rank) for ``queries(query_id, namespace, q)``; operators in q are words."""
        check_top_k(top_k)
        posted, sizes = self._none(f"namespace string, {_POSTING}"), []
        for name, own in self._manifest().namespaces.items():
            sizes.append((name, own["n_chunks"], own["n_words"]))
            posted = posted.unionByName(self._postings(own["segments"]).withColumn("namespace", F.lit(name)))
        n_chunks, n_words = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
        if self.scope == "index":
            sizes = [(s[0], n_chunks, n_words) for s in sizes]
        stats = self.spark.createDataFrame([(name, n, words / n) for name, n, words in sizes if n], "namespace string, n_chunks long, avg_length double")
        return search_postings(posted, stats, queries, top_k, stem=self.stem, scope=self.scope)

    def _postings(self, segments: list[dict]) -> DataFrame:
        """Live (id, term, tf, length); segments written by a store with other words give theirs from the texts."""

        def part(segment: dict) -> DataFrame:
            if segment["stem"] == self.stem:
                return self._stored(segment, "postings", _POSTING)
            return self._made_postings(self._stored(segment, "chunks", STORED_CHUNK))

        return self._live(segments, "postings", _POSTING, part)

    def _made_postings(self, chunks: DataFrame) -> DataFrame:
        return postings(chunks.withColumn("search_text", _searched()), stem=self.stem).select(*(c.split()[0] for c in _POSTING.split(", ")))

    def vector_search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, namespace, id, score, rank) for ``queries(query_id, namespace, vector)``; checked even over nothing."""
        check_top_k(top_k)
        widths = {n["width"] for n in self._manifest().namespaces.values() if n["width"]}
        for q in queries.select("vector").toLocalIterator():
            check_query_vector(q["vector"], next(iter(widths), None))
        return vector_search(self._searchable(), queries, top_k)

    # -- writes -----------------------------------------------------------

    def apply(self, namespace: str, write: StoreWrite) -> None:
        """All or nothing: removals, then restated rows, then upserts, then document rows.

        Of what is held only ids, document ids and word counts are read, and the vectors of restated chunks.
        """
        folder = f"data/{uuid.uuid4().hex}"
        given = lambda df, schema: df if df is not None else self._none(schema)
        upsert, restate, documents = self._none(STORED_CHUNK), self._none(CHUNK), self._none(INDEXED_DOCUMENT)
        if write.upsert is not None:
            upsert = self._put(write.upsert.select(*CHUNK_COLUMNS, F.col("embedding").cast("array<float>")), folder, "upsert")
        if write.restate is not None:
            restate = self._put(write.restate.select(*CHUNK_COLUMNS), folder, "restate")
        if write.documents is not None:
            documents = self._put(write.documents.select("doc_id", "content_hash").dropDuplicates(["doc_id"]), folder, "documents")
        gone_chunks = given(write.remove_chunks, "chunk_id string").select(F.col("chunk_id").alias("id")).distinct()
        gone_docs = given(write.remove_documents, "doc_id string").select("doc_id").distinct()
        width = self._check(namespace, upsert, restate, documents)
        before = self._manifest()
        own = before.namespaces.get(namespace, {"segments": [], "width": None, "n_chunks": 0, "n_words": 0})
        held = self._live(own["segments"], "chunks", _HELD)
        keys = held.select("id", "doc_id", "n_words")
        leaving = keys.join(gone_docs, "doc_id", "left_semi").unionByName(keys.join(gone_chunks, "id", "left_semi")).select("id")
        restated = restate.dropDuplicates(["id"])
        if restated.select("id").join(keys, "id", "left_anti").union(restated.select("id").join(leaving, "id", "left_semi")).limit(1).count():
            raise ValueError("a restated chunk is not held, or leaves in the same write")
        fresh = upsert.dropDuplicates(["id"])
        changed = restated.join(fresh.select("id"), "id", "left_anti").join(held.select("id", "embedding"), "id").select(*CHUNK_COLUMNS, "embedding")
        words = F.size(words_of(_searched())).cast("long").alias("n_words")
        rows = self._put(changed.unionByName(fresh).select("*", words), folder, "chunks", _HELD)
        ids = leaving.union(rows.select("id")).distinct()
        gone = self._put(keys.join(ids, "id", "left_semi").select("id", "n_words"), folder, "gone_chunks", _GONE)
        gone_documents = self._put(gone_docs.union(documents.select("doc_id")).distinct(), folder, "gone_documents")
        total = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        (n_rows, more), (n_gone, less) = total(rows), total(gone)
        n_kept = own["n_chunks"] - n_gone + n_rows - fresh.count()  # held before, and restated or untouched
        old_width = own["width"] if n_kept else None
        others = before.width_beside(namespace) or old_width
        if width and others and width != others:
            raise ValueError(f"the index holds vectors of width {others}, the write brings {width}")
        if n_rows:
            self._put(_in_term_order(self._made_postings(rows)), folder, "postings")
        segment = {"folder": folder, "stem": self.stem, "n_rows": n_rows, "n_documents": documents.count(), "n_gone": n_gone, "n_gone_documents": gone_documents.count()}
        segments = self._merged([*own["segments"], segment]) if _size(segment) or not own["segments"] else own["segments"]
        entry = {"segments": segments, "width": width or old_width, "n_chunks": own["n_chunks"] + n_rows - n_gone, "n_words": own["n_words"] + more - less}
        self._publish(replace(before, number=before.number + 1, schema_version=SCHEMA_VERSION, namespaces={**before.namespaces, namespace: entry}))

    def _put(self, df: DataFrame, folder: str, what: str, schema: str | None = None) -> DataFrame:
        """Write a table of a segment and read it back, so that it is computed once."""
        path = f"{self.path}/{folder}/{what}"
        df.write.parquet(path)
        return self.spark.read.schema(schema or df.schema).parquet(path)

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The newest segments as one, as far back as ``MERGE_FACTOR`` reaches."""
        first, size = len(segments) - 1, _size(segments[-1])
        while first and _size(segments[first - 1]) <= MERGE_FACTOR * size:
            first -= 1
            size += _size(segments[first])
        tail, folder = segments[first:], f"data/{uuid.uuid4().hex}"
        if len(tail) == 1:
            return segments
        n_rows = self._put(self._live(tail, "chunks", _HELD), folder, "chunks").count()
        n_documents = self._put(self._live(tail, "documents", INDEXED_DOCUMENT), folder, "documents").count()
        self._put(_in_term_order(self._postings(tail)), folder, "postings")
        made = {"folder": folder, "stem": self.stem, "n_rows": n_rows, "n_documents": n_documents, "n_gone": 0, "n_gone_documents": 0}
        if first:  # what earlier segments lose is still to be taken back
            for what, key, count in (("gone_chunks", "id", "n_gone"), ("gone_documents", "doc_id", "n_gone_documents")):
                parts = [self._stored(s, what, f"{key} string") for s in tail if s[count]]
                if parts:
                    made[count] = self._put(reduce(DataFrame.union, parts).distinct(), folder, what).count()
        return [*segments[:first], made]

    def _check(self, namespace: str, upsert: DataFrame, restate: DataFrame, documents: DataFrame) -> int | None:
        """One aggregate over the write, before anything is stored."""
        nul = lambda *cols: F.max(F.greatest(*[F.contains(F.coalesce(F.col(c), F.lit("")), F.lit("\x00")) for c in cols], F.lit(False)))
        strings = ("id", "doc_id", "namespace", "uri", "title", "text", "hash")
        v = F.col("embedding")
        sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        got = upsert.agg(
            F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.min(F.coalesce(sound, F.lit(False))).alias("finite"),
            F.min(F.exists(v, lambda x: x != 0)).alias("some"), F.min(F.col("namespace") == namespace).alias("own"), nul(*strings).alias("nul"),
        ).first()
        others = restate.agg(F.min(F.col("namespace") == namespace).alias("own"), nul(*strings).alias("nul")).first()
        rows = documents.agg(nul("doc_id", "content_hash").alias("nul")).first()
        if got["own"] is False or others["own"] is False:
            raise ValueError(f"a chunk belongs to another namespace than {namespace}")
        if got["nul"] or others["nul"] or rows["nul"] or "\x00" in namespace:
            raise ValueError("ids, texts and hashes may not hold a NUL")
        if got["high"] is not None:
            if got["low"] is None or got["low"] <= 0:
                raise ValueError("a chunk has an empty vector")
            if got["low"] != got["high"]:
                raise ValueError(f"one write brings vectors of widths {got['low']} and {got['high']}")
            if not got["finite"]:
                raise ValueError("a chunk has a non-finite vector")
            if not got["some"]:
                raise ValueError("a chunk has a zero vector")
        return got["high"]


def _searched() -> Column:
    return search_text(F.col("title"), F.col("heading_path"), F.col("text"))


def _in_term_order(posted: DataFrame) -> DataFrame:
    """In ranges of (term, id), so that a frequent term fills many files."""
    return posted.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def _size(segment: dict) -> int:
    return sum(segment[n] for n in ("n_rows", "n_documents", "n_gone", "n_gone_documents"))


class MemoryStore(ParquetStore):
    """The same contract for one session: a folder of its own, plain words, statistics per namespace."""

    stem, scope = False, "namespace"

    def __init__(self, spark: SparkSession, **options):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        super().__init__(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}" if folder else tempfile.mkdtemp(prefix="skerry-store-"), **options)
