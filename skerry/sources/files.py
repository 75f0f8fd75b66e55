"""Documents from files: text, Markdown and HTML under folders, every refusal a row.

The driver lists names (hidden entries, symbolic links and globs are decided
there); the bytes are read, measured, hashed and decoded by executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_hash, document_id, path_title
from ..schema import DOCUMENT, FAILURE

#: What is read by default, what is not, and the size limit in bytes.
INCLUDE = ("**/*.md", "**/*.mdx", "**/*.markdown", "**/*.txt", "**/*.html", "**/*.htm")
EXCLUDE = ("**/node_modules/**",)
DEFAULT_MAX_BYTES = 5_000_000


def _glob(pattern: str) -> re.Pattern:
    """``**/`` is any folders, ``*`` and ``?`` stay within one; a trailing ``/**`` names the folder as well."""
    out = ""
    for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", pattern):
        out += {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part[0] == "[" and len(part) > 1 else re.escape(part))
    return re.compile(out + r"\Z")


def common_root(paths: Sequence[str]) -> str:
    """Deepest folder that holds all inputs, whatever their order."""
    folders = [p if os.path.isdir(p) else os.path.dirname(p) for p in map(os.path.abspath, paths)]
    return os.path.commonpath(folders) if folders else os.getcwd()


def _listed(inputs: Sequence[str], root: str, include: Sequence[str], exclude: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
    """uri to path of what to read, and uri to reason of what not."""
    wanted, unwanted = [_glob(p) for p in include], [_glob(p) for p in exclude]
    found: dict[str, str] = {}
    failed: dict[str, str] = {}
    uri = lambda path: os.path.relpath(path, root).replace(os.sep, "/")

    def walk(folder: str, base: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            failed[uri(folder)] = e.strerror or str(e)
            return
        for e in entries:
            name = os.path.relpath(e.path, base).replace(os.sep, "/")
            if e.name.startswith(".") or any(p.match(name) for p in unwanted):
                continue
            if e.is_symlink():
                if e.is_dir() or any(p.match(name) for p in wanted):
                    failed[uri(e.path)] = "symbolic link skipped"
            elif e.is_dir():
                walk(e.path, base)
            elif any(p.match(name) for p in wanted):
                found[uri(e.path)] = e.path

    for path in map(os.path.abspath, inputs):
        if os.path.islink(path):
            failed[uri(path)] = "symbolic link skipped"
        elif os.path.isdir(path):
            walk(path, path)
        elif os.path.exists(path):
            found[uri(path)] = path
        else:
            failed[uri(path)] = "no such file or folder"
    return found, failed


def refusal(size: Column, text: Column, max_bytes: int) -> Column:
    """Why a file is not read, or null."""
    large = F.concat(F.lit("file is "), size.cast("string"), F.lit(f" bytes, over the {max_bytes} byte limit"))
    return F.when(size > max_bytes, large).when(F.contains(text, F.lit("\x00")), "looks like a binary file")


def load_files(
    spark: SparkSession, inputs: str | Sequence[str], *, namespace: str = "default", include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE, root: str | None = None, max_bytes: int = DEFAULT_MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(documents, failures), each sorted by uri.  A file named outright is read whatever the patterns."""
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    base = os.path.abspath(root) if root else common_root(inputs)
    found, failed = _listed(inputs, base, include, exclude)
    refused = spark.createDataFrame(sorted(failed.items()), FAILURE)
    if not found:
        return spark.createDataFrame([], DOCUMENT), refused
    names = spark.createDataFrame([(u, p) for u, p in sorted(found.items())], "uri string, path string")
    raw = spark.read.format("binaryFile").load([literal_path(p) for p in found.values()])
    # bytes that are not UTF-8 become U+FFFD; the size is tested before any content is read
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = raw.withColumn("path", F.call_function("url_decode", F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))).join(F.broadcast(names), "path")
    large = rows.where(F.col("length") > max_bytes).select("uri", refusal(F.col("length"), F.lit(""), max_bytes).alias("reason"))
    rows = rows.where(F.col("length") <= max_bytes).select("uri", "length", "modificationTime", "content", text.alias("text"))
    rows = rows.withColumn("reason", refusal(F.col("length"), F.col("text"), max_bytes))
    documents = rows.where("reason is null").select(
        document_id(F.lit(namespace), F.col("uri")).alias("id"),
        F.lit(namespace).alias("namespace"),
        "uri",
        path_title(F.col("uri")).alias("title"),
        "text",
        content_hash(F.col("content")).alias("content_hash"),
        F.create_map(F.lit("bytes"), F.col("length").cast("string"), F.lit("modifiedAt"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("metadata"),
        F.lit(None).cast("timestamp").alias("indexed_at"),
    )
    failures = refused.unionByName(large).unionByName(rows.where("reason is not null").select("uri", "reason"))
    return documents.orderBy("uri"), failures.orderBy("uri")


def literal_path(path: str) -> str:
    """A path that Spark's globbing takes literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


