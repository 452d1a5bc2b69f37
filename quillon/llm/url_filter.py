"""URL filters: a cascade of Bloom filters that answers exactly for every key of the corpus.

Rules name a host and the beginning of a path. Of each url the keys are taken that a rule of one of the rules'
shapes (labels of the host, characters of the path) could name. Level 1 of a cascade encodes the listed keys.
Those of all the corpus's other keys that it lets through are level 2, the listed keys that level 2 lets through
are level 3, and so on until none is left. A key is listed if the first level that lacks it has an even number,
which is right for each key of the universe; so no url is joined with the lists.

Level 1 lets through about as many keys as are listed, so the size of all levels follows the lists, not the corpus. They
are literals in the plan up to `LITERAL_WORDS` words; lists beyond that are looked up by an equi-join.

Everything is DataFrame expressions. Defined results: a null url, or one without "://", has an empty host and
path and no rule; repeated pages give one row each; of two rules that fit, the longer wins; the same key in both
lists is refused; empty pages give an empty result; empty lists allow all; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 32 bits in all levels of a cascade.
LITERAL_WORDS = 1 << 16
LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits in words of 32, and how often keys are hashed."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(64 * self.number + s)), F.lit(self.bits)) for s in range(self.hashes)]

    def filled(self, keys: DataFrame) -> Level:
        """With the bits of the keys; as many rows come to the driver as there are words."""
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        got = place.groupBy(F.expr("p div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b")).collect()
        words = [0] * -(-self.bits // 32)
        for w, b in got:
            words[w] = b
        return Level(self.number, self.bits, self.hashes, tuple(words))

    def has(self, key: Column) -> Column:
        held = F.array(*map(F.lit, self.words)) if len(self.words) <= 256 else F.expr(f"array({', '.join(f'{w}L' for w in self.words)})")
        one = [F.expr("true")]
        for p in self.places(key):
            word = F.element_at(held.cast("array<bigint>"), (F.floor(p / 32) + 1).cast("int"))
            one.append(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 32).cast("int"))) != 0)
        out = one[0]
        for c in one[1:]:
            out = out & c
        return out


@dataclass(frozen=True)
class Cascade:
    """Levels in order; `listed` holds the keys instead where the levels would be too large for literals."""

    levels: tuple[Level, ...]
    listed: DataFrame | None = None

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 0))
        return F.coalesce(out, F.lit(False))


def level_for(number: int, keys: int, others: int) -> Level:
    """Level 1 lets about keys / sqrt(2) of the other keys through, later levels half of them."""
    rate = min(0.5, keys / (math.sqrt(2) * max(1, others))) if number == 1 else 0.5
    return Level(number, max(64, math.ceil(keys * math.log(1 / rate) / math.log(2) ** 2)), max(1, round(math.log2(1 / rate))))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys over the universe, both with a column `key`; the universe is a written table of distinct keys."""
    listed = listed.distinct()
    n, every = listed.count(), universe.count()
    if not n:
        return Cascade(())
    if 4 * n * max(1.0, math.log2(max(2, every) / n)) / 32 > LITERAL_WORDS:
        return Cascade((), listed)
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    sizes, levels = [n, max(0, every - n)], []
    for number in range(1, LEVELS + 1):
        level = level_for(number, sizes[0], sizes[1]).filled(inside)
        levels.append(level)
        passed = written(outside.where(level.has(F.col("key"))), "passed")
        count = passed.count()
        if not count:
            return Cascade(tuple(levels))
        inside, outside, sizes = passed, inside, [count, sizes[0]]
    raise RuntimeError("the cascade did not end")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each (labels, characters) the key that a rule of this shape would have, or null."""
    labels = F.size(F.split(host, r"\."))
    return [F.when((host != "") & (labels >= n) & (F.length(path) >= c), F.concat(F.substring_index(host, ".", -n), F.substring(path, F.lit(1), F.lit(c)))) for n, c in shapes]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each page: host, path, rule (of the longest rule that fits, host and path) and verdict. rules: (host, path, allow or block)."""
    spark = pages.sparkSession
    names = [h + p for h, p, _ in rules]
    if len(set(names)) < len(names):
        raise ValueError("a key is listed twice")
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = keys_of(F.col("host"), F.col("path"), shapes)
    universe = written(parts.select(F.explode(F.array(*keys)).alias("key")).where("key is not null").distinct(), "universe")
    verdicts = {}
    for verdict in ("allow", "block"):
        mine = [F.lit(h + p) for h, p, v in rules if v == verdict]
        if mine:
            verdicts[verdict] = build(spark.range(1).select(F.explode(F.array(*mine)).alias("key")), universe)

    found = parts.select(key, "host", "path", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    hits = []
    for verdict, cascade in verdicts.items():
        for i in range(len(keys)):
            k = F.col(f"_k{i}")
            if cascade.listed is not None:  # too many keys for literals
                side = cascade.listed.select(F.col("key").alias(f"_l{verdict}{i}")).distinct()
                found = found.join(side, k == F.col(f"_l{verdict}{i}"), "left")
                fits = F.col(f"_l{verdict}{i}").isNotNull()
            else:
                fits = cascade.contains(k)
            hits.append(F.when(fits, F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    told = found.select(key, "host", "path", best.alias("best"))
    return told.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
