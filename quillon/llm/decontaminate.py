"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

A text is lower-cased (A-Z) and cut into runs of letters, digits and characters beyond ASCII. Every `window`
consecutive words of an item are a pattern, or all its words if it has fewer. The automaton reads each
document's normalised text once; where a pattern ends, its words are hit, and a word's place leads back to its
bytes in the original text.

Items are taken in shards of at most `SHARD_BYTES` of patterns, so that what is broadcast has a bound; documents
are read once for each shard, and a document's findings in several shards are united, with their bytes.

Defined results: null or empty texts have no words and are never hit; an item without words has no window and
occurs nowhere; repeated documents give one row each; items with the same text are found together; items with
the same id count once, those without an id as one item whose id is empty; very long texts are read whole; an empty
table of documents gives no rows, one of items no hits; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import kept, map_arrow, written

WINDOW = 10
#: Bytes of patterns in one automaton.
SHARD_BYTES = 4 << 20
#: What separates words becomes a space, A-Z become a-z.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in SEPARATORS else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def windows_of(text: str | None, window: int) -> set[bytes]:
    """An item's patterns: its words joined by single spaces, with one before and one behind."""
    words = words_of(text)
    return {b" %s " % b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()


class Scanner:
    """The automaton of one shard. Patterns are Latin-1 spelled bytes; each leads to its number of words and its items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        import ahocorasick

        held: dict[bytes, set] = {}
        for item, text in items:
            for pattern in windows_of(text, window):
                held.setdefault(pattern, set()).add(item)
        self.automaton = ahocorasick.Automaton() if held else None
        for pattern, found in held.items():
            self.automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, tuple(found)))
        if self.automaton is not None:
            self.automaton.make_automaton()

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """(words, [(first, end) word places of each match], items that occur)."""
        words = data.translate(TO_WORDS).split()
        spans: list[tuple[int, int]] = []
        found: set = set()
        if words and self.automaton is not None:
            text = " %s " % b" ".join(words).decode("latin-1")
            seen = counted = 0
            for end, (n, items) in self.automaton.iter(text):
                counted += text.count(" ", seen, end + 1)  # the spaces up to the one behind the last word
                seen = end + 1
                spans.append((counted - 1 - n, counted - 1))
                found.update(items)
        return len(words), spans, found


def covered(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The spans (first, end) united, in order; spans that also tell their bytes, (first, end, first byte, end byte), keep them."""
    out: list[tuple[int, ...]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1] = tuple(span[k] if k % 2 else out[-1][k] for k in range(len(span)))
        else:
            out.append(tuple(span))
    return out


def offsets(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of words lie in the original text, in bytes."""
    word = np.frombuffer(data.translate(TO_WORDS), np.uint8) != 0x20
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


def scanner(packed: bytes, window: int) -> Scanner:
    """One for each Python worker and shard."""
    return kept(lambda: Scanner(pickle.loads(zlib.decompress(packed)), window), "scanner", packed, window)


def shards(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in shards of bounded pattern bytes; only one shard is ever on the driver."""
    cost = F.lit(WINDOW) * (F.coalesce(F.octet_length(text), F.lit(0)) + 16)
    total = benchmark.agg(F.sum(cost)).first()[0] or 0
    n = max(1, -(-total // SHARD_BYTES))
    if n == 1:
        yield [tuple(r) for r in benchmark.select(item, text).collect()]
        return
    dealt = written(benchmark.select(item, text, F.pmod(F.xxhash64(item, text), F.lit(2 * n)).alias("_shard")), "items")
    for k in range(2 * n):
        yield [tuple(r) for r in dealt.where(F.col("_shard") == k).select(item, text).collect()]


#: A span of words and where it lies, as each shard's task tells it.
PLACE = ("first", "end", "first_byte", "end_byte")
PLACES = "array<struct<first:long,end:long,first_byte:long,end_byte:long>>"
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_bytes array<struct<first:long,end:long>>"


def named(items: set) -> list[str]:
    """Item ids as sorted text; a null id is an empty one."""
    return sorted("" if i is None else str(i) for i in items)


def digest(items: set) -> str:
    return hashlib.sha256(",".join(named(items)).encode()).hexdigest()


def scan(docs: DataFrame, items: list, window: int, text: str, key: str, part: bool = False) -> DataFrame:
    """Documents against one shard: the result, or with `part` what a shard adds to it."""
    kind = dict(docs.dtypes)[key]
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(items), 1))
    schema = f"{key} {kind}, " + (f"_text string, n_words long, spans {PLACES}, items array<string>" if part else RESULT)
    span = pa.list_(pa.struct([(c, pa.int64()) for c in (PLACE if part else PLACE[:2])]))
    names = [key, *(("_text", "n_words", "spans", "items") if part else ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_bytes"))]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = scanner(packed.value, window)
        made: list[tuple] = []
        for value in batch.column(1).to_pylist():
            data = (value or "").encode("utf-8", "surrogatepass")
            n, spans, found = machine.scan(data)
            spans = covered(spans)
            places = offsets(data, spans) if spans else []
            if part:
                made.append((hashlib.sha256(data).hexdigest(), n, [dict(zip(PLACE, (*s, *p), strict=True)) for s, p in zip(spans, places, strict=True)], named(found)))
            else:
                made.append((n, sum(b - a for a, b in spans), len(found), digest(found), bool(spans), [{"first": a, "end": b} for a, b in places]))
        kinds = [pa.string(), pa.int64(), span, pa.list_(pa.string())] if part else [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]
        return pa.record_batch([batch.column(0), *(pa.array(v, k) for v, k in zip(zip(*made, strict=True), kinds, strict=True))], names=names)

    return map_arrow(docs.select(key, text), over, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated, and hit_bytes, where the hits lie in its UTF-8 bytes."""
    kind = dict(docs.dtypes)[key]
    items = shards(benchmark, item, item_text)
    first = next(items)
    rest = list_of_parts = None
    for shard in items:
        if rest is None:
            list_of_parts = [written(scan(docs, first, window, text, key, part=True), "hits")]
            rest = True
        list_of_parts.append(written(scan(docs, shard, window, text, key, part=True).where("size(spans) > 0"), "hits"))
    if rest is None:
        return scan(docs, first, window, text, key)

    # several shards: the first has a row for every document, the others for those that they hit
    base, *more = list_of_parts
    others = more[0]
    for m in more[1:]:
        others = others.unionByName(m)
    others = others.dropDuplicates().groupBy(key, "_text").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    both = base.alias("b").join(others.alias("o"), F.col(f"b.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col("b._text") == F.col("o._text")), "left")
    none_s, none_i = F.expr(f"cast(array() as {PLACES})"), F.expr("cast(array() as array<string>)")
    both = both.select(
        F.col(f"b.{key}").alias(key), F.col("b.n_words").alias("n_words"), F.concat("b.spans", F.coalesce("o.spans", none_s)).alias("spans"), F.array_distinct(F.concat("b.items", F.coalesce("o.items", none_i))).alias("items")
    )

    def unite(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [covered([tuple(s[c] for c in PLACE) for s in v]) for v in batch.column(2).to_pylist()]
        found = [set(v) for v in batch.column(3).to_pylist()]
        places = [[{"first": a, "end": b} for *_, a, b in s] for s in spans]
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array([sum(b - a for a, b, *_ in s) for s in spans], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([digest(f) for f in found]), pa.array([bool(s) for s in spans]), pa.array(places, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
            names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_bytes"],
        )

    return map_arrow(both, unite, f"{key} {kind}, {RESULT}")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, whole rows, that hold no window of any item. One shard of items after the other passes over what is left."""
    place = docs.columns.index(text)
    for items in shards(benchmark, item, item_text):
        packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(items), 1))

        def over(batch: pa.RecordBatch, packed=packed) -> pa.RecordBatch:
            machine = scanner(packed.value, window)
            return batch.filter(pa.array([not machine.scan((t or "").encode("utf-8", "surrogatepass"))[1] for t in batch.column(place).to_pylist()]))

        docs = map_arrow(docs, over, docs.schema)
    return docs
