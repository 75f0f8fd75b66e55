"""Documents from a list of urls: no crawling, order kept, every refusal a row.

Urls are dealt to ``concurrency`` tasks; each fetches its own with retries.
The fetcher is a parameter, so tests and other transports need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content_hash, document_id, url_title
from ..schema import DOCUMENT
from .files import DEFAULT_MAX_BYTES

#: Statuses worth another try besides 5xx, and content types that are text.
RETRY_STATUSES = (408, 425, 429)
TEXT_TYPES = r"(?i)^text/|html|xml|json|markdown"


@dataclass(frozen=True)
class Response:
    status: int
    url: str
    headers: dict[str, str]
    body: bytes


@dataclass(frozen=True)
class UrlOptions:
    namespace: str = "default"
    concurrency: int = 4
    timeout_s: float = 15.0
    retries: int = 2
    retry_delay_s: float = 0.25
    max_bytes: int = DEFAULT_MAX_BYTES
    user_agent: str = "skerry"
    headers: dict[str, str] = field(default_factory=dict)
    #: Asked before every request, where it is made; true ends the read with the reason "cancelled".
    cancelled: Callable[[], bool] | None = None


Fetch = Callable[[str, UrlOptions], Response]


def http_fetch(url: str, options: UrlOptions) -> Response:
    """One request; reads at most one byte more than the limit."""
    request = urllib.request.Request(url, headers={"User-Agent": options.user_agent, **options.headers})
    try:
        with urllib.request.urlopen(request, timeout=options.timeout_s) as r:
            headers = {k.lower(): v for k, v in r.headers.items()}
            declared = headers.get("content-length", "")
            body = b"" if declared.isdigit() and int(declared) > options.max_bytes else r.read(options.max_bytes + 1)
            return Response(r.status, r.url, headers, body)
    except urllib.error.HTTPError as e:
        return Response(e.code, e.url or url, {k.lower(): v for k, v in e.headers.items()}, b"")


def _pause(response: Response | None, attempt: int, options: UrlOptions) -> float:
    after = response.headers.get("retry-after", "") if response else ""
    return float(after) if after.isdigit() else options.retry_delay_s * 2**attempt


def _attempts(url: str, options: UrlOptions, fetch: Fetch, sleep: Callable[[float], None]) -> tuple[Response | None, str]:
    """The last response and "", or None and the reason."""
    for attempt in range(options.retries + 1):
        response, reason = None, ""
        if options.cancelled and options.cancelled():
            return None, "cancelled"
        try:
            response = fetch(url, options)
        except TimeoutError:
            reason = "timed out"
        except Exception as e:  # every refusal of a transport becomes a row
            cause = getattr(e, "reason", e)
            reason = "timed out" if isinstance(cause, TimeoutError) else str(cause) or type(e).__name__
        again = response is None or response.status in RETRY_STATUSES or response.status >= 500
        if not again or attempt == options.retries:
            return response, reason
        sleep(_pause(response, attempt, options))
    return None, "no attempt was made"


def _fetcher(options: UrlOptions, fetch: Fetch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ordinal, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                response, reason = _attempts(url, options, fetch, time.sleep)
                row = {"ordinal": ordinal, "url": url, "status": None, "final": None, "headers": None, "body": None, "reason": reason or None}
                if response is not None:
                    row |= {"status": response.status, "final": response.url, "headers": json.dumps(response.headers), "body": response.body}
                yield pa.RecordBatch.from_pylist([row], _ARROW)

    return run


_ARROW = pa.schema([("ordinal", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("final", pa.string()), ("headers", pa.string()), ("body", pa.binary()), ("reason", pa.string())])
_FETCHED = "ordinal long, url string, status int, final string, headers string, body binary, reason string"


def load_urls(spark: SparkSession, inputs: str | Sequence[str], options: UrlOptions | None = None, fetch: Fetch = http_fetch) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) in input order; a url listed twice is fetched once; ids follow the final address."""
    o = options or UrlOptions()
    urls = list(dict.fromkeys([inputs] if isinstance(inputs, str) else inputs))
    asked = spark.createDataFrame(list(enumerate(urls)), "ordinal long, url string").repartition(max(1, min(o.concurrency, len(urls))), "ordinal")
    header = lambda name: F.get_json_object("headers", f"$['{name}']")
    got = asked.mapInArrow(_fetcher(o, fetch), _FETCHED).persist()
    text = F.make_valid_utf8(F.col("body").cast("string"))
    kind = header("content-type")
    length = header("content-length").try_cast("long")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when((F.coalesce(kind, F.lit("")) != "") & ~kind.rlike(TEXT_TYPES), F.concat(F.lit("unsupported content type: "), kind))
        .when(length > o.max_bytes, F.concat(F.lit("response is "), length.cast("string"), F.lit(f" bytes, over the {o.max_bytes} byte limit")))
        .when(F.length("body") > o.max_bytes, F.lit(f"response is over the {o.max_bytes} byte limit"))
        .when(F.contains(text, F.lit("\x00")), F.lit("looks like a binary response"))
    )
    rows = got.withColumn("text", text).withColumn("why", reason)
    values = {"status": F.col("status").cast("string"), "contentType": kind, "bytes": F.length("body").cast("string"), "etag": header("etag"), "lastModified": header("last-modified")}
    metadata = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    first = Window.partitionBy("final").orderBy("ordinal")
    documents = (
        rows.where("why is null")
        .withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .orderBy("ordinal")
        .select(
            document_id(F.lit(o.namespace), F.col("final")).alias("id"),
            F.lit(o.namespace).alias("namespace"),
            F.col("final").alias("uri"),
            url_title(F.col("final"), F.col("text")).alias("title"),
            "text",
            content_hash(F.col("body")).alias("content_hash"),
            metadata.alias("metadata"),
            F.lit(None).cast("timestamp").alias("indexed_at"),
        )
    )
    assert [f.name for f in documents.schema] == [c.split()[0] for c in DOCUMENT.split(", ")]
    return documents, rows.where("why is not null").orderBy("ordinal").select(F.col("url").alias("uri"), F.col("why").alias("reason"))
