"""Operator 5, personal data: exact base patterns, and spans added by a conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and not
overlapping within a kind; what fails its check (parts above 255, Luhn, number
of digits) is dropped without another try.  They are found in time linear in
the text.

The field tags tokens (runs of letters, runs of digits, single marks) around
*triggers*: digits, ``@``, "(at)", "[at]" and the word "dot".  Tokens more than
``REACH`` away from any trigger are untagged by definition.  It is trained once
a session on the driver from the small labelled table below, and decoded by
Viterbi in numpy batches.  An added span must not overlap a base span and must
look like its kind (digits enough, a valid checksum, parts up to 255).

One pass over the texts; nothing is shuffled, only the weights are broadcast.
Texts are worked in slices of bytes, windows in batches of tokens, so memory
follows neither the rows of a batch nor their longest text; one long window
takes some 100 bytes a token.

Defined results.  Null and empty texts have no spans.  Rows are kept one to
one.  Positions are code points, ends exclusive.  Only the named columns are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, texts_in, whole_rows, with_text
from .crf import Crf, train
from .labelled import by_id

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[] ?at ?[)\]]|(?<![^\W\d_])dot(?![^\W\d_])", re.I)
#: What an added email must look like: a name, "@" or "at", and parts joined by "." or "dot", with or without brackets.
_SPELT = re.compile(r"[\w.%+-]+\s*(?:@|[(\[]\s*at\s*[)\]]|\bat\b)\s*[\w-]+(?:(?:\.|\s*[(\[]\s*dot\s*[)\]]\s*|\s*\bdot\b\s*)[\w-]+)+", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")

Span = tuple[str, int, int]

#: The labelled table.  {kind:...} marks a span; 0 stands for any digit, # for a number up to 255, w for a made-up word.
LABELLED = """
w w {phone:(000) 000-0000} w w
w w {phone:(000)000-0000}, w w
w w {phone:000-000-0000} w w
w w {phone:000.000.0000} w w
w {phone:0 (000) 000-0000} w w
w w: {phone:1-000-000-0000}. w
tel {phone:000 000 0000} w
phone {phone:000 0000000} w
call {phone:00 00 00 00 00} w
{phone:+00 000 000000} w w
w w {phone:+0 (000) 000-0000} w w
w {email:w (at) w.com} w
w w {email:w [at] w.org} w w
w {email:w.w (at) w (dot) net} w
w {email:w [at] w [dot] com}, w
mail {email:w at w dot com} w
w {email:w00 at w dot w dot org} w
w w {email:w@w.com} w
w w {email:w.00@w0.w.com} w w
{email:w_w@w.net}. W w
w w {ip:#.#.#.#} w w
w {ip:#.#.#.#}: w w
w {ip:# . # . # . #} w w
w {ip:#[.]#[.]#[.]#} w
w {ip:# dot # dot # dot #} w
w w {card:0000000000000000} w w
w {card:0000 0000 0000 0000} w w
w w {card:0000.0000.0000.0000} w
w {card:0000/0000/0000/0000}, w w
w w w at w w w w
w w at w. W w w
w w w dot w w
w (w w) w w [w] w
W w 00 w w 0000 w w
w w 0000-00-00 w w
w w 00/00/0000 w w
w w 00:00 w 00:00:00 w
w 0.0 w 00.00 w 000.0
w v0.0.0 w w 0.0.0 w
w w 0,000,000 w w
w w 0. w w 0.0. w
w w 00% w w $00.00 w
w (0000) w w (00) w
w w "0w00w000w0w0000w00w" w w
w 0w0w00000w w00w000w0 w
w w 00000 w w 000000 w w
w w 00000000000000000000000000 w
w # w # w # w #
w w #0 -- 000 -- w
w w 000-00 w w w-00
w w @ w w
w @w w w
w w: w@w w w
w w w w w w w w
"""


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and _LOCAL.match(text[low - 1]):
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            out.append(("email", low, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_WORDS = {"at", "dot", "com", "org", "net", "tel", "phone", "call", "mail"}


def _shape(token: str) -> str:
    if token[0].isdigit():
        n = len(token)
        return f"d{n}" if n <= 4 else "d5" if n <= 6 else "d7" if n <= 11 else "d12" if n <= 19 else "d20"
    if token[0].isalpha():
        return token.lower() if token.lower() in _WORDS else "a"
    return token if token.isascii() else "p"


def _features(tokens: list[tuple[int, int]], text: str) -> Iterator[list[str]]:
    shapes = ["<", "<", *(_shape(text[a:b]) for a, b in tokens), ">", ">"]
    glue = [False, *(tokens[i][0] == tokens[i - 1][1] for i in range(1, len(tokens))), False]
    for i in range(len(tokens)):
        a, b, c, d, e = shapes[i : i + 5]
        left, right = "_+"[glue[i]], "_+"[glue[i + 1]]
        yield [f"0{c}", f"1{b}{left}{c}", f"2{c}{right}{d}", f"3{b}{left}{c}{right}{d}", f"4{a} {b}{left}{c}", f"5{c}{right}{d} {e}", f"6{a} {c}", f"7{c} {e}"]


def labelled_table(copies: int = 12, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """The rows of ``LABELLED`` with made-up words and digits, ``copies`` times."""
    rng = np.random.default_rng(seed)
    out = []
    for line in LABELLED.strip().splitlines() * copies:
        text, spans, opened = "", [], None
        for part in re.findall(r"\{[a-z]+:|\}|[a-zA-Z]+|.", line):
            if part[0] == "{" and len(part) > 1:
                opened = (part[1:-1], len(text))
            elif part == "}" and opened:
                spans.append((*opened, len(text)))
                opened = None
            elif part in ("w", "W"):
                word = "".join(rng.choice(list("abcdefghilmnoprstuvz"), rng.integers(2, 10)))
                text += word.title() if part == "W" else word
            elif part == "0":
                text += str(rng.integers(0, 10))
            elif part == "#":
                text += str(rng.integers(0, 256))
            else:
                text += part
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Crf:
    sequences, tags = [], []
    for text, spans in labelled_table():
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        own = [0] * len(tokens)
        for kind, low, high in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if low <= a and b <= high]
            for i in inside:
                own[i] = TAGS.index(("B-" if i == inside[0] else "I-") + kind)
        sequences.append(list(_features(tokens, text)))
        tags.append(own)
    return train(sequences, tags, len(TAGS))


def _fits(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(_SPELT.fullmatch(text))


def _before(text: str, done: int, low: int) -> list[tuple[int, int]]:
    """The last REACH tokens of text[done:low], found by looking back until one more is there, which may be cut."""
    width = 24 * REACH
    while True:
        start = max(done, low - width)
        found = [x.span() for x in _TOKEN.finditer(text, start, low)]
        if start == done or len(found) > REACH:
            return found[-REACH:]
        width *= 4


def _windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens within REACH tokens of a trigger; their cost follows the triggers, not the text."""
    done = 0
    run: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        low = m.start()
        if low < done:
            continue
        before = _before(text, done, low)
        if run and before and (before[0][0] > run[-1][1] and _TOKEN.search(text, run[-1][1], before[0][0])):
            yield run
            run = []
        run += before
        n, tokens = 0, _TOKEN.finditer(text, low)
        for x in tokens:
            run.append(x.span())
            n = 0 if _TRIGGER.match(text, x.start()) else n + 1
            if n >= REACH:
                break
        done = run[-1][1]
    if run:
        yield run


def all_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    windows = [(i, w) for i, t in enumerate(texts) for w in _windows(t)]
    added: dict[int, list[Span]] = {}
    for (i, tokens), tags in zip(windows, crf.viterbi([(len(w), _features(w, texts[i])) for i, w in windows])):
        j = 0
        while j < len(tags):
            if tags[j] == 0:
                j += 1
                continue
            kind, low = KINDS[(tags[j] - 1) // 2], tokens[j][0]
            k = j + 1
            while k < len(tags) and TAGS[tags[k]] == f"I-{kind}":
                k += 1
            last = k - 1
            while last > j and texts[i][tokens[last][0] : tokens[last][1]] in ".,;:!?":
                last -= 1
            span = (kind, low, tokens[last][1])
            if all(span[2] <= a or b <= span[1] for _, a, b in base[i]) and _fits(kind, texts[i][span[1] : span[2]]):
                added.setdefault(i, []).append(span)
            j = k
    return [(b, sorted(b + added.get(i, []), key=lambda s: (s[1], KINDS.index(s[0])))) for i, b in enumerate(base)]


_SPAN = pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64())])
_SPAN_SQL = "array<struct<kind:string,from:long,to:long>>"


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones together) replaced by the name of its first kind."""
    parts, done = [], 0
    for kind, low, high in spans:
        if low >= done:
            parts += [text[done:low], f"[{kind.upper()}]"]
        done = max(done, high)
    return "".join([*parts, text[done:]])


def scan_texts(rows: DataFrame, *, redact: bool = False) -> DataFrame:
    """For ``rows`` of (row, text), or of (row) with the text in it: row, base, spans (arrays of kind, from, to), and with ``redact`` clean_text."""
    crf = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, _, _ in byte_slices(texts_in(whole)):
                b = whole.slice(lo, hi - lo)
                texts = texts_in(b).to_pylist()
                found = all_spans(texts, crf)
                as_rows = lambda spans: [{"kind": k, "from": x, "to": y} for k, x, y in spans]
                out = {"row": b.column(0), "base": pa.array([as_rows(f[0]) for f in found], pa.list_(_SPAN)), "spans": pa.array([as_rows(f[1]) for f in found], pa.list_(_SPAN))}
                if redact:
                    out["clean_text"] = pa.array([redacted(t, f[1]) for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = f"row {rows.schema['row'].dataType.simpleString()}, base {_SPAN_SQL}, spans {_SPAN_SQL}" + ", clean_text string" * redact
    return rows.mapInArrow(run, schema)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row."""
    found = scan_texts(by_id(docs))
    return found.select("row.doc_id", "base", "spans")


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans replaced by their kind, all columns; ``n_chars`` follows the text."""
    found = scan_texts(whole_rows(docs), redact=True)
    return found.select(*with_text(docs, "row", F.size("spans") > 0, F.col("clean_text")))
