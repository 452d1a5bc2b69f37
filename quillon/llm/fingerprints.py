"""Document fingerprints: prefix polynomial hashes, span equality and longest common extensions.

`PrefixHashes` keeps, modulo two primes, the running sums of code point times power of the base. Two spans are
equal if the differences of their prefixes are, moved to the same power; the longest common extension of two places
is found by binary search over such comparisons.

A fingerprint is the bounded part of these arrays that two documents can be compared by: the length, the hash of
the whole, and the prefix hashes at the text's marks. Marks are the places where the distinct windows of WINDOW code
points with the MARKS smallest window hashes first stand, so an edit elsewhere in the text doesn't move them; a few places at multiples of
a power of two are known besides, for texts that repeat one pattern. `likeness` lays two fingerprints side by side at
windows that both have (and at their beginnings), extends each match by binary search over the places that lie at the
same distance in both, and gives the share of both texts that is matched.

Defined results: a null text is an empty one; equal texts have equal fingerprints, and likeness 1 whatever their length;
an empty text and another are alike by 0. Very long texts are hashed whole, in blocks, so that no more than the block's
arrays are held. Repeated rows and ids give one row each; in the order of ids, rows of the same id are ordered by their
texts, null ids come last; a table of one row is followed by itself; an empty table gives no rows; further columns, also
those named like results, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BATCH_BYTES, cut, give_back, map_arrow, small_batches

#: Two primes below 2^31 and the bases of the polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
#: Code points of a window, marks of a fingerprint, places of its grid, code points that are hashed at once.
WINDOW, MARKS, GRID, BLOCK = 8, 16, 16, 1 << 18
#: Documents of a range that is put in order by one task, on average; ranges at most (larger ones are sorted on disk and
#: read as a stream, so their size is not bound by memory); places that are sampled for each range.
RANGE, RANGES, SAMPLED = 2048, 8192, 24


class _Powers:
    """base^n and base^-n modulo each prime, for n up to the longest text met."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        for arrays, bases in ((self.up, BASES), (self.down, tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)))):
            for k, p in enumerate(PRIMES):
                while len(arrays[k]) <= n:
                    step = np.uint64(int(arrays[k][-1]) * bases[k] % p)
                    arrays[k] = np.concatenate([arrays[k], arrays[k] * step % np.uint64(p)])


POWERS = _Powers()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(codes: np.ndarray) -> list[np.ndarray]:
    """For each prime the hashes of all prefixes of up to BLOCK or so code points, the empty one first."""
    POWERS.reach(len(codes))
    out = []
    for k, p in enumerate(PRIMES):
        h = np.zeros(len(codes) + 1, np.uint64)
        # each term is below 2^31, so sums of 2^33 of them fit
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * POWERS.up[k][: len(codes)] % np.uint64(p), out=h[1:])
        out.append(h % np.uint64(p))
    return out


class PrefixHashes:
    """The prefix hashes of one text: equality of any two spans, and the longest common extension of any two places."""

    def __init__(self, text: str):
        self.n = len(text)
        self.arrays = prefixes(points(text))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of text[start:end], the same wherever it stands."""
        return tuple((int(h[end]) - int(h[start])) * int(POWERS.down[k][start]) % PRIMES[k] for k, h in enumerate(self.arrays))

    def equal(self, start: int, other: PrefixHashes, place: int, length: int) -> bool:
        """Whether length code points from start on equal those of the other text from place on."""
        if min(start, place, length) < 0 or start + length > self.n or place + length > other.n:
            return False
        POWERS.reach(max(self.n, other.n))
        return self.span(start, start + length) == other.span(place, place + length)

    def extension(self, start: int, other: PrefixHashes, place: int) -> int:
        """How many code points from start on are those of the other text from place on."""
        low, high = 0, min(self.n - start, other.n - place)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start + low, other, place + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return low


def grid(n: int) -> range:
    """Places of a text of n code points whose prefix hashes are always known: multiples of a power of two, GRID at most."""
    step = 1
    while n > GRID * step:
        step *= 2
    return range(step, n, step)


def fingerprint(text: str | None) -> str:
    """The length, the whole hash, the prefix hashes of the grid, and up to MARKS marks (place, window hash, prefix hash), in base64."""
    codes = points(text or "")
    n, base = len(codes), (0, 0)
    known: list[tuple[int, ...]] = []
    kept: dict[int, tuple[int, int, int]] = {}
    for start in range(0, n, BLOCK):
        block = codes[start : start + BLOCK + WINDOW - 1]
        own = min(BLOCK, n - start)
        arrays = prefixes(block)
        window = np.minimum(np.arange(own) + WINDOW, len(block))
        parts = [(arrays[k][window] + np.uint64(p) - arrays[k][:own]) * POWERS.down[k][:own] % np.uint64(p) for k, p in enumerate(PRIMES)]
        order = ((parts[0] << np.uint64(31) | parts[1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        # the smallest distinct windows of the block: of those below a likely limit, if they are enough
        for limit in (8 * MARKS * 2**32 // own if own > 16 * MARKS else 2**32, 2**32):
            low = np.flatnonzero(order < np.uint64(limit)) if limit < 2**32 else np.arange(own)
            values, first = np.unique(order[low], return_index=True)
            if len(values) >= MARKS or limit == 2**32:
                break
        power = [pow(b, start, p) for b, p in zip(BASES, PRIMES, strict=True)] if start else [1, 1]
        upto = lambda at: tuple((base[k] + power[k] * int(arrays[k][at])) % p for k, p in enumerate(PRIMES))  # noqa: B023, E731
        for value, at in zip(values[:MARKS].tolist(), low[first[:MARKS]].tolist(), strict=True):
            if value not in kept:
                kept[value] = (start + at, *upto(at))
        for value in sorted(kept)[MARKS:]:
            del kept[value]
        known += [upto(at - start) for at in grid(n) if start <= at < start + own]
        base = upto(own)
    head = struct.pack("<QII", n, *base) + b"".join(struct.pack("<II", *h) for h in known)
    rows = sorted((at, value, a, b) for value, (at, a, b) in kept.items())
    return base64.b64encode(head + b"".join(struct.pack("<QIII", *r) for r in rows)).decode("ascii")


class Marks:
    """A fingerprint, read."""

    def __init__(self, told: str):
        raw = base64.b64decode(told)
        self.n, *self.whole = struct.unpack_from("<QII", raw)
        places = grid(self.n)
        self.known = {0: (0, 0), self.n: tuple(self.whole)} | {at: struct.unpack_from("<II", raw, 16 + 8 * k) for k, at in enumerate(places)}
        #: (place, window hash, prefix hashes), by place.
        self.rows = [struct.unpack_from("<QIII", raw, k) for k in range(16 + 8 * len(places), len(raw), 20)]

    def limit(self) -> int:
        """Of windows with hashes up to this one, all that the text has are marks."""
        return max(r[1] for r in self.rows) if len(self.rows) >= MARKS else 1 << 32

    def prefix(self, limit: int) -> dict[int, tuple[int, int]]:
        """The prefix hash at each place that is known."""
        return self.known | {r[0]: r[2:] for r in self.rows if r[1] <= limit}


def _same(a: dict, b: dict, i: int, j: int, length: int) -> bool:
    """Whether the spans of this length from i and from j on have the same hash: the earlier one's is moved to the other's power."""
    for k, p in enumerate(PRIMES):
        x, y = a[i + length][k] - a[i][k], b[j + length][k] - b[j][k]
        x, y = (x * pow(BASES[k], j - i, p), y) if j > i else (x, y * pow(BASES[k], i - j, p))
        if (x - y) % p:
            return False
    return True


def likeness(one: str, other: str) -> float:
    """The share of two texts that matches, by their fingerprints: 0 to 1, and 1 for equal ones."""
    if one == other:
        return 1.0
    a, b = Marks(one), Marks(other)
    if not a.n or not b.n:
        return 0.0
    limit = min(a.limit(), b.limit())
    left, right = a.prefix(limit), b.prefix(limit)
    found = {r[1]: r[0] for r in b.rows if r[1] <= limit}
    anchors = sorted({(0, 0)} | {(r[0], found[r[1]]) for r in a.rows if r[1] in found and r[1] <= limit})
    matched, end = 0, 0
    for i, j in anchors:
        if i < end:
            continue
        ends = sorted(x - i for x in left if x > i and x - i + j in right)
        low, high = 0, len(ends)  # of the spans that end at marks of both, the longest that is equal
        while low < high:
            middle = (low + high + 1) // 2
            if _same(left, right, i, j, ends[middle - 1]):
                low = middle
            else:
                high = middle - 1
        if low:
            matched += ends[low - 1]
            end = i + ends[low - 1]
        elif (i, j) != (0, 0):  # the window itself is the same
            length = min(WINDOW, a.n - i, b.n - j)
            matched, end = matched + length, i + length
    return min(2 * matched / (a.n + b.n), 1.0)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, n_chars, fingerprint. Nothing is shuffled."""
    kind = dict(docs.dtypes)[key]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], names=[key, "n_chars", "fingerprint"])

    return map_arrow(docs.select(key, text), over, f"{key} {kind}, n_chars long, fingerprint string")


def ranges(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(bucket, guest, key, hash, text): each row in the bucket of its range of keys, in descending order, and as the guest of the bucket before if it is the first of its own; the first of all is the guest of the last.

    Bounds are chosen from a sample of hashes of (key, text), whose size is in proportion to the number of ranges; they decide how
    work is dealt out, never a result. Rows that share a key are spread by their texts' hashes.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ids = own.select("_k", "_h")
    rows = ids.count()
    n = min(max(1, rows // RANGE), RANGES)
    every = max(1, rows // (n * SAMPLED))
    place = F.struct(F.col("_k").isNotNull().alias("told"), F.col("_k").alias("k"), F.col("_h").alias("h"))
    sample = [r[0] for r in ids.where(F.pmod(F.xxhash64("_k", "_h"), F.lit(every)) == 0).select(place).distinct().limit(4 * n * SAMPLED).collect()]
    sample.sort(key=lambda r: (r.told, r.k if r.told else 0, r.h))
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) > n else []
    bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]
    kind = f"array<struct<told:boolean,k:{dict(docs.dtypes)[key]},h:bigint>>"
    steps = max(1, len(bounds)).bit_length()
    if bounds:
        listed = F.from_json(F.lit(json.dumps([b.asDict() for b in bounds], default=str)), kind)
        # how many bounds lie at or below the row's place, by binary lifting
        lift = F.aggregate(F.sequence(F.lit(steps), F.lit(0), F.lit(-1)), F.lit(0), lambda at, k: F.when((at + _two(k) <= F.lit(len(bounds))) & (F.get(listed, at + _two(k) - 1) <= F.col("_p")), at + _two(k)).otherwise(at))
        placed = lambda rows: rows.withColumn("_p", place).withColumn("bucket", F.lit(len(bounds)) - lift).drop("_p")
    else:
        placed = lambda rows: rows.withColumn("bucket", F.lit(0))
    firsts = sorted((r.bucket, r.first) for r in placed(ids).groupBy("bucket").agg(F.max(place).alias("first")).collect())
    guests = [(b, *first, firsts[i - 1][0]) for i, (b, first) in enumerate(firsts)]
    told = spark.createDataFrame(guests, f"bucket int, told boolean, _k {dict(docs.dtypes)[key]}, _h long, before int").drop("told")
    joined = placed(own).join(F.broadcast(told.withColumnRenamed("_k", "_fk").withColumnRenamed("_h", "_fh")), "bucket")
    stands = F.struct("bucket", F.lit(False).alias("guest"))
    also = F.col("_k").eqNullSafe(F.col("_fk")) & (F.col("_h") == F.col("_fh"))
    each = joined.withColumn("_e", F.explode(F.when(also, F.array(stands, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(stands))))
    return each.select("_e.bucket", "_e.guest", "_k", "_h", "_t")


def _two(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness, also to the next document's.

    The edited text has the last third replaced by as many code points from the beginning of the next document in
    descending order of keys. Texts are shuffled once, by ranges of keys; a task reads its ranges in order and holds
    one batch and the row before.
    """
    kind = dict(docs.dtypes)[key]
    placed = ranges(docs, text, key)
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("_k"), F.desc("_h"))
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, key, text, fingerprint) of the row before
        for whole in batches:
            for batch in cut(whole, BATCH_BYTES):
                out: list[tuple] = []
                for bucket, guest, k, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    if guest and last is None:  # a second guest: the same text again
                        continue
                    t = t or ""
                    told = fingerprint(t)
                    if last is not None and last[0] == bucket:
                        n = len(last[2])
                        edited = last[2][: n - n // 3] + t[: n // 3]
                        own = fingerprint(edited)
                        out.append((last[1], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last[3], own, likeness(last[3], own), likeness(last[3], told)))
                    last = None if guest else (bucket, k, t, told)
                if out:
                    types[0] = batch.schema.field(2).type
                    yield pa.record_batch([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), types, strict=True)], names=names)
        give_back()

    small_batches(docs.sparkSession)
    return ordered.select("bucket", "guest", "_k", "_t").mapInArrow(over, f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
