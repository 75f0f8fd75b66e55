"""HTML to blocks: the content of a page without its furniture, as Markdown, then as blocks.

Uses the standard library's tokenizer to build a small tree, picks the content
root, drops noise, and writes Markdown.  Block offsets refer to that text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from .markdown import parse_markdown

#: Elements that never hold content, and page furniture where no content root is marked.
#: Links and characters from which an element can be a link list; its links hold more than half of it.
LINKS, CHARACTERS = 3, 20
#: Elements that are never content.
NOISE = "script style noscript iframe svg nav aside form dialog button".split()
CHROME_TAGS, CHROME_ROLES = ("header", "footer"), ("navigation", "banner", "contentinfo", "search")
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = set("address article blockquote dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table tr ul body html".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_INVISIBLE = re.compile(r"[​-‍﻿\s¶§]")
_ZERO_WIDTH = re.compile(r"[​-‍﻿]")


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def drop(self, test: Callable[[Element], bool]) -> None:
        """Remove every descendant for which the test holds, outermost first."""
        self.children = [c for c in self.children if isinstance(c, str) or not test(c)]
        for c in self.children:
            if isinstance(c, Element):
                c.drop(test)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for closed in _CLOSES.get(tag, ()):
            if self.open[-1].tag == closed:
                self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _visible(e: Element) -> str:
    return _INVISIBLE.sub("", e.text())


def _links(e: Element) -> list[Element]:
    return [x for x in e.walk() if x.tag == "a"]


def _content_list(e: Element) -> bool:
    """A list of links into the page itself: a table of contents."""
    links = _links(e)
    items = sum(x.tag == "li" for x in e.walk())
    return e.tag in ("ul", "ol") and len(links) > 1 and len(links) == items and all(x.attrs.get("href", "").startswith("#") for x in links)


def _mostly_links(e: Element) -> bool:
    links, total = _links(e), len(_visible(e))
    return len(links) >= LINKS and total >= CHARACTERS and sum(len(_visible(x)) for x in links) > total / 2


def content_root(document: Element) -> tuple[Element, bool]:
    """The page's content, and whether the page marks it."""
    for test in (lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: e.attrs.get("role") == "main"):
        if found := document.first(test):
            return found, True
    body = document.first(lambda e: e.tag == "body") or document
    body.drop(lambda e: e.tag in CHROME_TAGS or e.attrs.get("role") in CHROME_ROLES)
    return body, False


def _resolve(root: Element, url: str) -> None:
    for link in _links(root):
        if "href" in link.attrs:
            try:
                full = urljoin(url, link.attrs["href"])
                if not urlsplit(full).scheme:
                    raise ValueError(full)
                link.attrs["href"] = full
            except ValueError:
                del link.attrs["href"]


def _inline(e: Element | str, pre: bool = False) -> str:
    if isinstance(e, str):
        return e if pre else re.sub(r"\s+", " ", e)
    inner = "".join(_inline(c, pre) for c in e.children)
    core = inner.strip()
    pad = lambda mark: inner.replace(core, f"{mark}{core}{mark}") if core else inner
    if e.tag == "br":
        return "\n"
    if e.tag == "img":
        return e.attrs.get("alt", "")
    if e.tag in ("strong", "b"):
        return pad("**")
    if e.tag in ("em", "i"):
        return pad("_")
    if e.tag == "code" and not pre:
        return pad("`")
    if e.tag == "a" and e.attrs.get("href") and core:
        return inner.replace(core, f"[{core}]({e.attrs['href']})", 1)
    return inner


def _table(e: Element) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip() for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _blocks(e: Element) -> list[str]:
    """The element's content as Markdown blocks."""
    out: list[str] = []
    run = ""

    def flush() -> None:
        nonlocal run
        text = "\n".join(x.strip() for x in re.sub(r"[ \t]+", " ", run).split("\n")).strip()
        if text:
            out.append(text)
        run = ""

    for c in e.children:
        if isinstance(c, str) or (c.tag not in _BLOCKS and not c.first(lambda x: x.tag in _BLOCKS)):
            run += _inline(c)
            continue
        flush()
        if re.fullmatch("h[1-6]", c.tag):
            text = re.sub(r"\s+", " ", _inline(c)).strip()
            out += ["#" * int(c.tag[1]) + " " + text] if text else []
        elif c.tag == "pre":
            language = re.search(r"language-(\S+)", " ".join(x.attrs.get("class", "") for x in [c, *c.walk()]))
            out.append(f"```{language[1] if language else ''}\n{_inline(c, True).strip(chr(10))}\n```")
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate(x for x in c.children if isinstance(x, Element) and x.tag == "li"):
                mark = f"{k + 1}. " if c.tag == "ol" else "* "
                inner = _blocks(li)
                tight = "\n".join(inner) if all("\n" not in b or b.lstrip().startswith(("* ", "1. ")) for b in inner) else "\n\n".join(inner)
                items += [mark + tight.replace("\n", "\n" + " " * len(mark))] if inner else []
            out += ["\n".join(items)] if items else []
        elif c.tag == "blockquote":
            inner = "\n\n".join(_blocks(c))
            out += ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        elif c.tag == "table":
            out += [t] if (t := _table(c)) else []
        elif c.tag == "hr":
            out.append("---")
        else:
            out += _blocks(c)
    flush()
    return out


def parse_html(html: str, url: str | None = None) -> dict:
    """title, text (Markdown), blocks."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    tag = builder.root.first(lambda e: e.tag == "title")
    title = tag.text().strip() if tag else None
    root, marked = content_root(builder.root)
    root.drop(lambda e: e.tag in NOISE)
    root.drop(_content_list)
    root.drop(lambda e: e.tag == "a" and not _visible(e))
    if url:
        _resolve(root, url)
    if not marked:
        root.drop(_mostly_links)
    text = _ZERO_WIDTH.sub("", "\n\n".join(_blocks(root)))
    parsed = parse_markdown(re.sub(r"\n{3,}", "\n\n", text).strip())
    return parsed | {"title": parsed["title"] or title}
