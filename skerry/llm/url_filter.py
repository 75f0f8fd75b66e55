"""Operator 10, URL filters: a Bloom filter cascade in DataFrame expressions only.

Rules are (host, path, verdict).  A rule fits its host and every subdomain of
it when the url's path starts with the rule's path; of several the longest
(host and path together, then host) wins.

The *key universe* is every (host suffix, path prefix) that a page of the
corpus could be judged by; only the path lengths that occur among the rules
matter, so a page has (labels of its host) x (those lengths) keys.  The rule
keys of one verdict are *listed*.  Level 0 is a Bloom filter of the listed
keys; level 1 of the universe's other keys that pass level 0; level 2 of the
listed keys that pass level 1; and so on until a level has no false positive.
A key is listed when the first level that does not hold it is odd.  Over the
universe this is exact, so judging a page needs no join: the levels are
one literal each in the expression.

Size.  Level 0 gets ``log2(universe / listed)`` times 1.44 bits a listed key,
so about as many other keys pass as there are listed ones, and every later
level halves them.  All levels together stay within a few dozen bits a rule
whatever the corpus; ``max_bits`` is checked before anything is sent.

Defined results.  A url that is null or has no ``://`` has empty host and path
and no rule.  With no fitting rule, ``rule`` is null and the verdict is
``default``.  Rules of empty tables, repeated pages and extra columns need no
care: the judgement reads one column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bits as 64-bit words, number of bits, hashes a key, seed."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that could judge a page: array of struct(size, host_size, key), no nulls."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))

    def key(s: Column, n: Column) -> Column:
        return F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key"))

    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: key(s, n))))
    return F.when(host != "", pairs).otherwise(F.slice(pairs, 1, 0))


def _positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.seed * 64 + j), key), F.lit(level.bits)) for j in range(level.hashes)]


def _holds(key: Column, level: Level) -> Column:
    words = F.split(F.lit(" ".join(map(str, level.words))), " ").cast("array<long>")  # one literal after constant folding
    found = None
    for p in _positions(key, level):
        word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
        bit = F.call_function("getbit", word, F.pmod(p, F.lit(64)).cast("int")) == 1
        found = bit if found is None else found & bit
    return found


def _build(keys: DataFrame, n: int, rate: float, seed: int, max_bits: int) -> Level:
    """Bits are set by a grouped bit_or, so only the filter itself reaches the driver."""
    bits = max(64, 64 * math.ceil(n * 1.44 * math.log2(1 / rate) / 64))
    if bits > max_bits:
        raise ValueError(f"level {seed} of the cascade needs {bits} bits for {n} keys; max_bits is {max_bits}")
    level = Level((), bits, max(1, round(math.log2(1 / rate))), seed)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("p"))
    rows = (
        at.groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Level(tuple(words), bits, level.hashes, seed)


def build_cascade(universe: DataFrame, listed: DataFrame, *, n_universe: int, max_bits: int = 1 << 23, max_levels: int = 40) -> list[Level]:
    """Levels for ``listed.key`` over the distinct ``universe.key``.

    Each round filters what the round before left: the two sides shrink by
    half or more, and the sets are written, never collected.
    """
    n_listed = listed.count()
    if not n_listed:
        return []
    levels: list[Level] = []
    inside, outside = listed, universe.join(F.broadcast(listed) if n_listed <= 10_000 else listed, "key", "left_anti")
    n_in, n_out = n_listed, n_universe
    while True:
        if len(levels) == max_levels:
            raise ValueError(f"the cascade has false positives after {max_levels} levels")
        rate = min(0.5, n_in / max(1, n_out)) if not levels else 0.5
        levels.append(level := _build(inside, n_in, rate, len(levels), max_bits))
        passed = written(outside.where(_holds(F.col("key"), level)), "cascade")
        n_passed = passed.count()
        if not n_passed:
            return levels
        inside, outside, n_in, n_out = passed, inside, n_passed, n_in


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe: nested from the last level outwards."""
    out = F.lit(bool(len(levels) % 2))
    for i in reversed(range(len(levels))):
        out = F.when(_holds(key, levels[i]), out).otherwise(F.lit(bool(i % 2)))
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    The rules are few and driver-side by nature (a configuration); the corpus
    side is a scan, one distinct count of keys, and the cascade's filters.
    """
    lengths = sorted({len(r.path) for r in rules})
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    seen = base.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("k"))
    universe = written(seen.select("k.key").distinct(), "url-keys")
    n_universe = universe.count()
    spark = pages.sparkSession
    fits = []
    for verdict in sorted({r.verdict for r in rules}):
        own = sorted({r.key for r in rules if r.verdict == verdict})
        levels = build_cascade(universe, spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in own])).alias("key")), n_universe=n_universe)
        fits.append((verdict, levels))

    def fitting(levels: list[Level], verdict: str) -> Column:
        return F.transform(
            F.filter("judged.keys", lambda k: is_listed(k["key"], levels)),
            lambda k: F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"), F.lit(verdict).alias("verdict")),
        )

    best = F.array_max(F.concat(*[fitting(levels, verdict) for verdict, levels in fits]))
    inner = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("page"), F.struct(candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys")).alias("judged"))
    return inner.withColumn("best", best).select(
        *[F.col("page")[c].alias(c) for c in base.columns], F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
