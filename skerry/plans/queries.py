"""Registered queries over the retrieval operators, with their SQL for DuckDB.

Every query reads whole tables.  Searches take a stated query set: all
benchmark items, or the vectors whose id is divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.chunk import chunk_documents, fixed_windows
from ..operators.evaluate import first_relevant, keep_cutoff, missed, nearest_rank, score_table, threshold_sweep
from ..operators.fusion import WITH_RERANKER, WITHOUT_RERANKER, fuse, weight_sweep
from ..operators.lexical import corpus_stats, lexical_search, postings
from ..operators.parse import blocks, parse_documents
from ..operators.rerank import rerank
from ..operators.store import MemoryStore
from ..operators.sync import classify, plan_update, summarize
from ..operators.vector import vector_search
from ..sources.corpus import CLEANING, clean_markdown
from ..sources.files import refusal
from . import fixtures
from .index import index_documents

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TOP_K = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | fixtures.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | fixtures.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared inputs ---------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.lit("corpus").alias("namespace"), F.col("doc_id").alias("id"), F.col("text").alias("search_text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.lit("corpus").alias("namespace"), F.col("text").alias("q"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").alias("id"), "embedding")
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "namespace", F.col("embedding").alias("vector"))
    return rows, asked


def _source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the engine's document schema, the source as namespace."""
    docs = _table(spark, sf_dir, "documents")
    uri = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(
        fn.document_id(F.col("source"), uri).alias("id"), F.col("source").alias("namespace"), uri.alias("uri"), F.concat_ws(" ", "source", "lang").alias("title"), "text",
        fn.content_hash(F.col("text")).alias("content_hash"), F.create_map(F.lit("bytes"), F.octet_length("text").cast("string")).alias("metadata"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select(
        fn.document_id(F.lit("web"), F.col("url")).alias("id"), F.lit("web").alias("namespace"), F.col("url").alias("uri"), fn.url_title(F.col("url"), F.col("html")).alias("title"), F.col("html").alias("text"),
        fn.content_hash(F.col("html")).alias("content_hash"), F.create_map(F.lit("contentType"), F.lit("text/html; charset=utf-8")).alias("metadata"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )


_TOKENS = r"""
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
stats AS (SELECT count(*) AS n_chunks, avg(len(ws)) AS avg_length FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(ws) AS len, unnest(ws) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT id, term, ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_length)) AS p FROM tf JOIN df USING (term), stats),
bm AS (SELECT query_id, id, round(sum(p), 9) AS score FROM part JOIN qt USING (term) GROUP BY query_id, id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 20)
"""
_VECTORS = """
vec AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0
),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 20)
"""


# -- sources, identity, text functions ------------------------------------


@query("SELECT page_id, substr(sha256('web' || chr(0) || url), 1, 16) AS id, sha256(html) AS content_hash FROM pages")
def document_ids(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", fn.document_id(F.lit("web"), F.col("url")).alias("id"), fn.content_hash(F.col("html")).alias("content_hash"))


@query("""SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'file is ' || strlen(text) || ' bytes, over the 10000 byte limit' WHEN contains(text, chr(0)) THEN 'looks like a binary file' END AS reason FROM documents""")
def load_refusals(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    reason = refusal(F.octet_length("text"), F.col("text"), 10_000)
    return docs.select("doc_id", reason.alias("reason"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(list_extract(string_split(url, '/'), -1), '^(.+)\.[^.]*$', '\1'), '[-_]+', ' ', 'g') AS title FROM pages""")
def placeholder_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.path_title(F.col("url")).alias("title"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def url_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.url_title(F.col("url"), F.col("html")).alias("title"))


@query(r"""
SELECT 'page' AS kind, page_id AS id, regexp_matches(url, '(?i)\.(html?|xhtml)(\?|#|$)') OR regexp_matches(html, '(?i)^\s*<(!doctype|html|head|body)\b') AS is_html FROM pages
UNION ALL SELECT 'document', doc_id, regexp_matches(text, '(?i)^\s*<(!doctype|html|head|body)\b') FROM documents""")
def format_dispatch(spark, sf_dir):
    none = F.lit(None).cast("string")
    pages = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), fn.is_html(none, F.col("url"), F.col("html")).alias("is_html"))
    docs = _table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", fn.is_html(none, F.lit(""), F.col("text")))
    return pages.union(docs)


@query("""SELECT doc_id, sha256(source || ' › ' || lang || chr(10) || text) AS hash, ceil(length(source || ' › ' || lang || chr(10) || text) / 4.0)::BIGINT AS tokens FROM documents""")
def chunk_fingerprints(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    text = fn.embed_text(F.col("source"), F.array("lang"), F.col("text"))
    return docs.select("doc_id", F.sha2(text, 256).alias("hash"), fn.estimate_tokens(text).alias("tokens"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), '‘’“”', '''''""'),
  '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]', '', 'g'), '\s+', ' ', 'g'))) AS normalized FROM documents""")
def evidence_normalizer(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.normalize_evidence(F.col("text")), 256).alias("normalized"))


def _cleaned_sql(text: str) -> str:
    """The corpus cleaning, pattern by pattern, as SQL."""
    for pattern, new in CLEANING:
        text = f"regexp_replace({text}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, sha256({_cleaned_sql('html')}) AS cleaned FROM pages UNION ALL SELECT -doc_id, sha256({_cleaned_sql('text')}) FROM documents")
def cleaned_corpus(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.sha2(clean_markdown(F.col("html")), 256).alias("cleaned"))
    return pages.union(_table(spark, sf_dir, "documents").select(-F.col("doc_id"), F.sha2(clean_markdown(F.col("text")), 256)))


@query("SELECT source AS namespace, count(*) AS documents, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY source")
def distinct_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("namespace")).agg(F.count("*").alias("documents"), F.count_distinct("text").alias("distinct_texts"))


@query("""SELECT doc_id, ord::INT AS ord, array_to_string(ws[ord * 100 + 1 : ord * 100 + 100], ' ') AS text
FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) + 99) // 100)) AS ord FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))""".replace("\\\\", "\\"))
def fixed_size_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fixed_windows(docs, 100).withColumnRenamed("id", "doc_id")


# -- parsing and chunking (no SQL form) ------------------------------------


@query()
def html_blocks(spark, sf_dir):
    return blocks(parse_documents(_pages(spark, sf_dir)))


@query()
def markdown_chunks(spark, sf_dir):
    return chunk_documents(parse_documents(_source_documents(spark, sf_dir)))[0].drop("text")


@query()
def page_chunks(spark, sf_dir):
    return chunk_documents(parse_documents(_pages(spark, sf_dir)))[0]


# -- keyword search --------------------------------------------------------


@query(r"""SELECT id, term, count(*) AS tf, any_value(n)::BIGINT AS length FROM (SELECT doc_id AS id, len(ws) AS n, unnest(ws) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)) GROUP BY id, term""")
def term_frequency(spark, sf_dir):
    return postings(_chunks(spark, sf_dir)).drop("namespace")


@query(r"""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term""")
def document_frequency(spark, sf_dir):
    return postings(_chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


@query(r"""SELECT source AS namespace, count(*) AS n_chunks, round(avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), 6) AS avg_length FROM documents GROUP BY source""")
def corpus_statistics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.col("doc_id").alias("id"), F.col("text").alias("search_text"))
    return corpus_stats(docs).withColumn("avg_length", F.round("avg_length", 6))


@query(f"WITH {_TOKENS} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM lex")
def bm25_topk(spark, sf_dir):
    hits = lexical_search(_chunks(spark, sf_dir), _questions(spark, sf_dir), TOP_K)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def bm25_stemmed_topk(spark, sf_dir):
    return lexical_search(_chunks(spark, sf_dir), _questions(spark, sf_dir), TOP_K, stem=True, scope="index").drop("namespace")


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: NOT list_contains(string_split('""" + " ".join(fn.text.STOP_WORDS) + r"""', ' '), w)) AS words FROM documents""")
def stop_word_terms(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fn.stop_words_removed(fn.terms(F.col("text"))).alias("words"))


# -- vector search ---------------------------------------------------------


@query(f"WITH {_VECTORS} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM near")
def vector_topk(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return vector_search(rows, asked, TOP_K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings""")
def vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(fn.norm(v), 6).alias("norm"), F.round(fn.l2_normalize(v)[0], 6).alias("first"))


@query("""SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 - power(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2) / 2, 5) AS score
FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0""")
def unit_distance_cosine(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    apart = F.sqrt(F.aggregate(F.zip_with("vector", "embedding", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))
    return rows.join(asked, "namespace").select("query_id", "id", F.round(fn.cosine_of_unit_distance(apart), 5).alias("score"))


# -- fusion, reranking -----------------------------------------------------


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lexical = lexical_search(_chunks(spark, sf_dir), _questions(spark, sf_dir), TOP_K).select("query_id", "id", "rank")
    rows, asked = _vectors(spark, sf_dir)
    return lexical, vector_search(rows, asked, TOP_K).select("query_id", "id", "rank")


def _fused_sql(weight: float) -> str:
    return f"""WITH {_TOKENS}, {_VECTORS},
    lists AS (SELECT query_id, id, {weight} / (60 + rank) AS p, rank AS l, NULL::BIGINT AS v FROM lex UNION ALL SELECT query_id, id, 1.0 / (60 + rank), NULL, rank FROM near),
    summed AS (SELECT query_id, id, sum(p::DOUBLE) AS s, min(l) AS l, min(v) AS v FROM lists GROUP BY query_id, id)
    SELECT query_id, id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, l NULLS LAST, v NULLS LAST)::INT AS rank FROM summed QUALIFY rank <= 20"""


@query(_fused_sql(1.0))
def rrf_with_reranker(spark, sf_dir):
    return fuse(*_lists(spark, sf_dir), WITH_RERANKER, top_k=TOP_K).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(_fused_sql(0.2))
def rrf_without_reranker(spark, sf_dir):
    return fuse(*_lists(spark, sf_dir), WITHOUT_RERANKER, top_k=TOP_K).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {_TOKENS}, {_VECTORS}, w AS (SELECT unnest([1.0, 0.5, 0.3, 0.2, 0.1])::DOUBLE AS share),
lists AS (SELECT share, query_id, id, share / (60 + rank) AS p, rank AS l, NULL::BIGINT AS v FROM lex, w UNION ALL SELECT share, query_id, id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM near, w),
summed AS (SELECT share, query_id, id, sum(p) AS s, min(l) AS l, min(v) AS v FROM lists GROUP BY share, query_id, id)
SELECT share, query_id, id, round(s, 9) AS score, row_number() OVER (PARTITION BY share, query_id ORDER BY s DESC, l NULLS LAST, v NULLS LAST)::INT AS rank FROM summed QUALIFY rank <= 20""")
def rrf_weight_sweep(spark, sf_dir):
    return weight_sweep(*_lists(spark, sf_dir), [1.0, 0.5, 0.3, 0.2, 0.1], top_k=TOP_K).withColumn("score", F.round("score", 9))


_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"


@query(f"""WITH {_TOKENS}, q AS (SELECT item_id AS query_id, {_WORDS} AS qs FROM benchmark), d AS (SELECT doc_id AS id, {_WORDS} AS ds FROM documents),
s AS (SELECT query_id, id, round(len(list_intersect(qs, ds)) / greatest(1, len(qs))::DOUBLE, 9) AS score FROM lex JOIN q USING (query_id) JOIN d USING (id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s""")
def reranked_topk(spark, sf_dir):
    hits = lexical_search(_chunks(spark, sf_dir), _questions(spark, sf_dir), TOP_K)
    return rerank(hits, _questions(spark, sf_dir), _chunks(spark, sf_dir).select("id", F.col("search_text").alias("text")))


# -- incremental update ----------------------------------------------------


def _snapshot(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loaded documents, and an index made of the labels: quality 1 has today's hash, toxic ones have no chunk record, and every vector's id beyond the documents is gone."""
    loaded = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", fn.content_hash(F.col("text")).alias("content_hash"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    old = labels.join(loaded.select(F.col("id").alias("doc_id"), "content_hash"), "doc_id")
    hashed = F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.lit("changed"))
    lost = _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("gone-"), F.col("vec_id").cast("string")).alias("doc_id"))
    indexed = old.select("doc_id", hashed.alias("content_hash")).unionByName(lost.select("doc_id", F.lit("x").alias("content_hash")))
    held = old.where("toxic = 0").select("doc_id", F.array(F.concat_ws("-", "doc_id", F.lit("0")), F.concat_ws("-", "doc_id", F.lit("old"))).alias("chunk_ids"))
    return loaded, indexed, held.unionByName(lost.select("doc_id", F.array(F.concat_ws("-", "doc_id", F.lit("0"))).alias("chunk_ids")))


_STATES = """
l AS (SELECT doc_id::VARCHAR AS id, sha256(text) AS h FROM documents),
o AS (SELECT b.doc_id::VARCHAR AS doc_id, CASE WHEN quality = 1 THEN h ELSE 'changed' END AS h, toxic FROM labels b JOIN l ON l.id = b.doc_id::VARCHAR),
ix AS (SELECT doc_id, h FROM o UNION ALL SELECT 'gone-' || vec_id, 'x' FROM embeddings),
held AS (SELECT doc_id, unnest([doc_id || '-0', doc_id || '-old']) AS chunk_id FROM o WHERE toxic = 0 UNION ALL SELECT 'gone-' || vec_id, 'gone-' || vec_id || '-0' FROM embeddings),
st AS (
  SELECT coalesce(l.id, ix.doc_id) AS doc_id, l.h AS content_hash,
         CASE WHEN l.id IS NULL THEN 'deleted' WHEN l.h = ix.h AND r.doc_id IS NOT NULL THEN 'unchanged' WHEN ix.doc_id IS NULL THEN 'added' ELSE 'updated' END AS state
  FROM l FULL OUTER JOIN ix ON l.id = ix.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM held) r ON r.doc_id = ix.doc_id
)"""


@query(f"WITH {_STATES} SELECT doc_id, content_hash, state FROM st")
def sync_states(spark, sf_dir):
    return classify(*_snapshot(spark, sf_dir), complete=True)


@query(f"""WITH {_STATES} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'updated') AS updated,
count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'deleted') AS deleted, 0::BIGINT AS held FROM st""")
def sync_summary(spark, sf_dir):
    return summarize(classify(*_snapshot(spark, sf_dir), complete=True))


@query(f"""WITH {_STATES} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'updated') AS updated,
count(*) FILTER (state = 'unchanged') AS unchanged, 0::BIGINT AS deleted, count(*) FILTER (state = 'deleted') AS held FROM st""")
def sync_partial_read(spark, sf_dir):
    return summarize(classify(*_snapshot(spark, sf_dir), complete=False))


@query(f"""WITH {_STATES}, fresh AS (SELECT doc_id, unnest([doc_id || '-0', doc_id || '-1']) AS chunk_id FROM st WHERE state IN ('added', 'updated'))
SELECT 'embed' AS kind, chunk_id FROM fresh WHERE chunk_id NOT IN (SELECT chunk_id FROM held)
UNION ALL SELECT 'restate', chunk_id FROM fresh WHERE chunk_id IN (SELECT chunk_id FROM held)
UNION ALL SELECT 'keep', chunk_id FROM held JOIN st USING (doc_id) WHERE state = 'unchanged'
UNION ALL SELECT 'remove', chunk_id FROM held JOIN st USING (doc_id) WHERE state = 'deleted' OR (state = 'updated' AND chunk_id NOT IN (SELECT chunk_id FROM fresh))""")
def sync_chunks(spark, sf_dir):
    loaded, indexed, held = _snapshot(spark, sf_dir)

    def chunk_of(docs: DataFrame) -> DataFrame:
        two = docs.select("id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("k"), "text")
        return two.select(
            F.concat_ws("-", "id", "k").alias("id"), F.col("id").alias("doc_id"), F.lit("corpus").alias("namespace"), F.lit("").alias("uri"), F.lit("").alias("title"), F.array().cast("array<string>").alias("heading_path"),
            "text", F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"), fn.estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"),
        )

    failures = spark.createDataFrame([], "uri string, reason string")
    plan = plan_update(loaded, failures, indexed, held, chunk_of)
    kinds = {"embed": plan.embed.select(F.col("id").alias("chunk_id")), "restate": plan.restate.select(F.col("id").alias("chunk_id")), "keep": plan.keep, "remove": plan.remove}
    out = None
    for kind, ids in kinds.items():
        part = ids.select(F.lit(kind).alias("kind"), "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def store_roundtrip(spark, sf_dir):
    store = MemoryStore(spark)
    failures = spark.createDataFrame([], "uri string, reason string")
    index_documents(store, "web", _pages(spark, sf_dir), failures)
    documents, held = store.snapshot("web")
    return documents.join(held, "doc_id").select("doc_id", "content_hash", F.size("chunk_ids").alias("chunks"))


# -- evaluation ------------------------------------------------------------

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[*_`]', '', 'g'), '\s+', ' ', 'g'))"
_RANKS = f"""
ev AS (SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'paraphrase' ELSE 'mixed' END AS type, {_NORMAL.format("text")} AS e FROM benchmark),
ranks AS (
  SELECT ev.id, ev.type, min(CASE WHEN contains({_NORMAL.format("d.text")}, ev.e) THEN lex.rank END) AS first_rank
  FROM ev LEFT JOIN lex ON lex.query_id = ev.id AND lex.rank <= 10 LEFT JOIN documents d ON d.doc_id = lex.id GROUP BY ev.id, ev.type
)"""


def _ranks(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(F.lit("exact"), F.lit("paraphrase"), F.lit("mixed")), (F.col("item_id") % 3 + 1).cast("int"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), kind.alias("type"), F.array(fn.normalize_evidence(F.col("text"))).alias("evidence"))
    hits = lexical_search(_chunks(spark, sf_dir), _questions(spark, sf_dir), 10)
    texts = _chunks(spark, sf_dir).select("id", F.col("search_text").alias("text"))
    return first_relevant(items, hits.join(texts, "id").select("query_id", "rank", "text"))


@query(f"WITH {_TOKENS}, {_RANKS} SELECT id, type, first_rank::INT AS first_rank FROM ranks")
def first_relevant_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"""WITH {_TOKENS}, {_RANKS} SELECT type, count(*) AS questions, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1,
round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM ranks GROUP BY ROLLUP (type)""")
def retrieval_scores(spark, sf_dir):
    return score_table(_ranks(spark, sf_dir)).select("type", "questions", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "mrr")])


@query(f"WITH {_TOKENS}, {_RANKS} SELECT list_sort(coalesce(list(id) FILTER (first_rank IS NULL OR first_rank > 5), [])) AS missed FROM ranks")
def missed_questions(spark, sf_dir):
    return missed(_ranks(spark, sf_dir))


@query("""WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT 'median' AS share, n_chars AS value FROM s WHERE i = floor(0.5 * n) UNION ALL SELECT 'p90', n_chars FROM s WHERE i = floor(0.9 * n)""")
def nearest_rank_quantiles(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    parts = [nearest_rank(docs, "n_chars", share).select(F.lit(name).alias("share"), "value") for name, share in (("median", 0.5), ("p90", 0.9))]
    return parts[0].unionByName(parts[1])


def _scores(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") / 1000, 1).alias("score"))
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").select("score", (F.col("quality") == 1).alias("answerable"))


_SCORES = "s AS (SELECT round(n_chars / 1000.0::DOUBLE, 1) AS score, quality = 1 AS answerable FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_SCORES}, t AS (SELECT DISTINCT score AS t FROM s),
r AS (SELECT t, avg(CASE WHEN score >= t THEN 1.0 ELSE 0 END) FILTER (answerable) AS kept, avg(CASE WHEN score < t THEN 1.0 ELSE 0 END) FILTER (NOT answerable) AS refused FROM s, t GROUP BY t)
SELECT t AS score, round(kept, 6) AS kept, round(refused, 6) AS refused, round((kept + refused) / 2, 6) AS balanced FROM r ORDER BY round((kept + refused) / 2, 12) DESC, t LIMIT 1""")
def abstain_threshold(spark, sf_dir):
    best = threshold_sweep(_scores(spark, sf_dir))
    return best.select("score", *[F.round(c, 6).alias(c) for c in ("kept", "refused", "balanced")])


@query(f"""WITH {_SCORES}, p AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM s WHERE answerable),
c AS (SELECT score AS cutoff FROM p WHERE i = floor(0.05 * n))
SELECT cutoff, round(avg(CASE WHEN score < cutoff THEN 1.0 ELSE 0 END), 6) AS refused FROM s, c WHERE NOT answerable GROUP BY cutoff""")
def keep_95_cutoff(spark, sf_dir):
    return keep_cutoff(_scores(spark, sf_dir)).select("cutoff", F.round("refused", 6).alias("refused"))
