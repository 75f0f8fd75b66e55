"""Where documents come from."""

from .corpus import clean_markdown, load_corpus
from .files import load_files
from .urls import Response, UrlOptions, load_urls

__all__ = ["Response", "UrlOptions", "clean_markdown", "load_corpus", "load_files", "load_urls"]
