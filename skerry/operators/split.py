"""Cutting a long text into pieces within a token budget: sentences, then words, then characters.

Sentence ends follow the public segmentation rules closely enough for prose: a
run of ``.``, ``!``, ``?`` or their full-width forms with closing quotes or
brackets, then white space; a full stop before a lower-case letter does not
end a sentence; line ends do.  Only cuts are made, so every piece is found in
the text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Counter = Callable[[str], int]

_END = re.compile(r"(?:[.!?]+[\"'”’)\]]*\s+|[。！？]+\s*|[।॥]\s*|(?<=\?)(?=\S)|\r?\n| | )")
#: What may not be cut, and by how much a piece that is too long shrinks.
_IN_URL = re.compile(r"(?:https?://|www\.)\S*$")
_SHRINK = 0.9


def sentences(text: str) -> Iterator[str]:
    """Segments that join to the text again."""
    start = 0
    for m in _END.finditer(text):
        following = text[m.end() : m.end() + 1]
        if m[0].startswith(".") and "\n" not in m[0] and following.islower():
            continue
        if m.end() > start:
            yield text[start : m.end()]
            start = m.end()
    if start < len(text):
        yield text[start:]


def _packed(parts: Iterable[str], budget: int, count: Counter, joined: Callable[[str, str], bool]) -> list[str]:
    """Greedy packing; ``joined(so_far, part)`` tells that no cut is allowed before the part."""
    out: list[str] = []
    so_far = ""
    for part in parts:
        if so_far.strip() and not joined(so_far, part) and count(so_far + part) > budget:
            out.append(so_far.strip())
            so_far = ""
        so_far += part
    return [*out, so_far.strip()] if so_far.strip() else out


def _by_characters(text: str, budget: int, count: Counter) -> list[str]:
    """Equal cuts at the text's own density, each shrunk by tenths until it fits; one character at least."""
    per_token = len(text) / max(1, count(text))
    out, at = [], 0
    while at < len(text):
        size = min(len(text) - at, max(1, int(per_token * budget)))
        while size > 1 and count(text[at : at + size]) > budget:
            size = int(size * _SHRINK)
        out.append(text[at : at + size])
        at += size
    return out


def split(text: str, budget: int, count: Counter) -> list[str]:
    """Pieces of at most ``budget`` tokens (a single character may be more), in order.

    >>> split("One. Two. Three.", 2, lambda t: len(t.split()))
    ['One. Two.', 'Three.']
    """
    out: list[str] = []
    for piece in _packed(sentences(text), budget, count, lambda a, b: bool(_IN_URL.search(a)) and not b[:1].isspace()):
        if count(piece) <= budget:
            out.append(piece)
            continue
        for words in _packed(re.split(r"(\s+)", piece), budget, count, lambda a, b: False):
            out += [words] if count(words) <= budget else _by_characters(words, budget, count)
    return out
