"""Text functions as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the title and headings in front of a chunk's text.
HEADER_SEPARATOR = " › "
#: Characters that have no width.
ZERO_WIDTH = "[​-‍﻿]"
#: Entities decoded in titles; the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
#: Words left out by the experiment's lexer.
STOP_WORDS = (
    "a an and are as at be but by can could do does did for from has have how i if in into is it its me my of on or our so that the their them then there these they "
    "this to up us was we what when where which who why will with would you your"
).split()


def document_id(namespace: Column, uri: Column) -> Column:
    """First 16 hex digits of sha256(namespace NUL uri)."""
    return F.substring(F.sha2(F.concat(namespace, F.lit("\x00"), uri), 256), 1, 16)


def content_hash(raw: Column) -> Column:
    """sha256 of the bytes (or of the UTF-8 text)."""
    return F.sha2(raw, 256)


def chunk_id(doc_id: Column, chunk_hash: Column) -> Column:
    return F.concat(doc_id, F.lit("-"), F.substring(chunk_hash, 1, 12))


def embed_text(title: Column, heading_path: Column, text: Column, *, header: bool = True) -> Column:
    """What an embedder reads: the named parts of the header on a line, then the text."""
    if not header:
        return text
    parts = F.filter(F.concat(F.array(title), heading_path), lambda p: p.isNotNull() & p.rlike(r"(?U)\S"))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, HEADER_SEPARATOR), F.lit("\n"), text)).otherwise(text)


def search_text(title: Column, heading_path: Column, text: Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, title, F.array_join(heading_path, separator), text)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stop_words_removed(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def path_title(uri: Column) -> Column:
    """Last path segment without its extension, runs of - and _ as a space."""
    name = F.regexp_replace(F.element_at(F.split(uri, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(name, "[-_]+", " ")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def decode_entities(text: Column) -> Column:
    for name, plain in ENTITIES.items():
        text = F.regexp_replace(text, f"(?i)&{name};", plain)
    return text


def _filled(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), F.trim(text))


def url_title(url: Column, body: Column) -> Column:
    """The page's <title>, else its first "# " line, else the last path segment, else the url."""
    tag = F.regexp_replace(decode_entities(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"(?U)\s+", " ")
    heading = F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)
    segment = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"://[^/]+/(?:.*/)?([^/]*)$", 1)
    return F.coalesce(_filled(tag), _filled(heading), _filled(segment), url)


def is_html(content_type: Column, uri: Column, text: Column) -> Column:
    """Format dispatch: the content type decides, then the extension, then how the text opens."""
    by_type = F.when(F.coalesce(content_type, F.lit("")) != "", content_type.rlike("(?i)html|xml"))
    named = F.coalesce(uri, F.lit("")).rlike(r"(?i)\.(html?|xhtml)(\?|#|$)")
    opens = F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*<(!doctype|html|head|body)\b")
    return F.coalesce(by_type, named | opens)


def normalize_evidence(text: Column) -> Column:
    """Lower case, straight quotes, no images, links as their text, no emphasis or code marks, single spaces."""
    out = F.translate(F.lower(text), "‘’“”", "''\"\"")
    for pattern, new in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]", ""), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)
