"""A Markdown corpus folder with component noise cleaned by expressions, sorted by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import load_files

#: What is removed, in this order, and what it becomes.
CLEANING = [
    (r"(?s)\A---\n.*?\n---\n", ""),
    (r"(?s)<head>.*?</head>", ""),
    (r"(?m)^import .*$", ""),
    (r"(?s)<CtaBox.*?/>", ""),
    (r"<img[^>]*/?>", ""),
    (r"(?m)^\s*</?div[^>]*>\s*$", ""),
    (r"(?m)^:::\w+[ \t]*(.*)$", "$1"),
    (r"(?m)^:::\s*$", ""),
    (r"\n{3,}", "\n\n"),
]


def clean_markdown(text: Column) -> Column:
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, text) of every ``.md`` but the licence; the id is the path, and the title without front matter."""
    documents, _ = load_files(spark, folder, include=("**/*.md",))
    kept = documents.where(~F.col("uri").rlike(r"(^|/)LICENSE\.md$"))
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    title = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?m)^title:\s*(.*)$", 1)), r"^[\"']|[\"']$", "")
    return kept.select(F.col("uri").alias("id"), F.coalesce(F.nullif(title, F.lit("")), F.col("uri")).alias("title"), clean_markdown(F.col("text")).alias("text")).orderBy("id")
