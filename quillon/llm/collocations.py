"""Phrase collocation mining: weighted acyclic automata of n-gram counts.

`Transducer` is a minimal acyclic automaton over words whose arcs carry counts. It is built incrementally from n-grams
in order: when the next n-gram leaves a branch, that branch's states are final and become one with equal ones met
before. Each task counts the n-grams of its shard of the documents, sorts them, and builds a transducer for each prefix
range; the transducers of a range are united, their weights summed. Counts of parts are looked up by composing the
sorted parts with the transducer of their range.

What can't be counted `least` times is left out early: a first reading counts words and pairs of neighbours in tables of
buckets (at most 2^BITS, one byte each), and a word or pair whose bucket stays below isn't counted in the second. Buckets
that others share can only let more through, so counts stay exact, whatever the size of the tables.

Defined results: a null text is empty, a null language is `und`; repeated rows and ids count as often as they stand
there; whole texts are read; ties are ordered as stated in `mine`; an empty table gives no rows; further columns, also
those named like results, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._common import BATCH_BYTES, cut, give_back, release, small_batches, written

#: Words of a phrase at most.
LONGEST = 4
#: Buckets of words and of pairs are at most 2 to these powers; buckets of one row.
WORD_BITS, BITS, SLICE = 22, 26, 1 << 16
#: Words of a shard, about; ranges at most, n-grams of a range, about, and places that are sampled for each.
SHARD, RANGES, RANGE, SAMPLED = 2_000_000, 1024, 100_000, 40
#: Bytes that end a piece, bytes between words.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

KIND = np.zeros(256, np.uint8)
KIND[list(SPACES)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, 4096, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x94D049BB133111EB) + right)


class Words:
    """The words of a batch: places in the lower-cased bytes, document, whether the next one stands behind in the same piece, and a hash that the language is part of."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        kind = KIND[self.data]
        inside, first = kind == 0, np.zeros(len(kind) + 1, bool)
        first[offsets] = True
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero((edge[:-1] == 1) | inside & first[:-1])
        self.end = np.flatnonzero((edge[1:] == -1) | inside & first[1:]) + 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.follows = np.append((piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1]), False) if len(piece) else np.zeros(0, bool)
        size = self.end - self.start
        own = self.data[inside].astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        at = np.arange(len(own), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        own *= FACTORS[at & 4095]
        salt = np.array([zlib.crc32(n.encode()) for n in langs], np.uint64) << np.uint64(20)
        number = {n: k for k, n in enumerate(dict.fromkeys(langs))}
        self.lang = np.array([number[n] for n in langs], np.int32)[self.doc]
        self.hash = mixed((np.add.reduceat(own, begin) if len(begin) else np.zeros(0, np.uint64)) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt[self.doc])

    def __len__(self) -> int:
        return len(self.start)

    def word(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode()

    def pairs(self) -> np.ndarray:
        """The hash of each word and the next one."""
        return pair_hash(self.hash, np.append(self.hash[1:], np.uint64(0)))

    def first_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the chosen words the place of one equal word for each that is different, and which of these each one is: by hashes, then checked byte by byte."""
        _, first, place = np.unique(self.hash[chosen], return_index=True, return_inverse=True)
        first = chosen[first]
        size, other = (self.end - self.start)[chosen], first[place]
        same = (size == (self.end - self.start)[other]) & (self.lang[chosen] == self.lang[other])
        if same.all():
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = (self.data[np.repeat(self.start[chosen], size) + at] == self.data[np.repeat(self.start[other], size) + at]).all()
        if not np.all(same):  # two words share a hash: tell them by their bytes
            _, first, place = np.unique(np.array([f"{self.lang[k]} {self.word(k)}" for k in chosen], object), return_index=True, return_inverse=True)
            first = chosen[first]
        return first, place


def batches_of(batches: Iterable[pa.RecordBatch], none: str) -> Iterator[tuple[Words, list[str]]]:
    for whole in batches:
        for batch in cut(whole, BATCH_BYTES):
            langs = [none if x is None else x for x in batch.column(1).to_pylist()]
            yield Words(batch.column(0), langs), langs


class Transducer:
    """Sorted n-grams and their counts: state k has the arcs first[k] to first[k + 1], each a word's number, a count (0: no n-gram ends here) and a next state."""

    def __init__(self, words: list[str], first: np.ndarray, symbol: np.ndarray, count: np.ndarray, target: np.ndarray):
        self.words, self.first, self.symbol, self.count, self.target = words, first, symbol, count, target

    @classmethod
    def build(cls, rows: np.ndarray, words: list[str]) -> Transducer:
        """From n-grams in order: rows of LONGEST word numbers (from 1; 0 behind the last) and a count, numbered in the words' order. The last state is the root."""
        register: dict[tuple, int] = {(): 0}
        # the open states' arcs, from the root: word, count, target, and so on
        path: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        last = [0] * LONGEST

        def close(level: int) -> None:
            """The state at a level gets no more arcs: it becomes one with an equal one, if there is any."""
            arcs = tuple(path[level])
            path[level] = []
            path[level - 1][-1] = register.setdefault(arcs, len(register))

        for k in range(0, len(rows), 20_000):
            for *gram, n in rows[k : k + 20_000].tolist():
                same = 0
                while gram[same] == last[same]:
                    same += 1
                for level in range(LONGEST - 1, same, -1):
                    if path[level]:
                        close(level)
                while same < LONGEST and gram[same]:
                    path[same] += (gram[same], 0, 0)
                    same += 1
                path[same - 1][-2] = n
                last = gram
        for level in range(LONGEST - 1, 0, -1):
            if path[level]:
                close(level)
        states = [*register, tuple(path[0])]
        flat = np.array([x for arcs in states for x in arcs], np.int64).reshape(-1, 3)
        used, symbol = np.unique(flat[:, 0], return_inverse=True)
        first = np.cumsum([0, *(len(arcs) // 3 for arcs in states)], dtype=np.int32)
        return cls([words[x - 1] for x in used.tolist()], first, symbol.astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32))

    @classmethod
    def of(cls, items: Iterable[tuple[tuple[str, ...], int]]) -> Transducer:
        """From sorted n-grams as words."""
        items = list(items)
        words = sorted({w for gram, _ in items for w in gram})
        number = {w: k for k, w in enumerate(words, 1)}
        rows = [[*(number[w] for w in gram), *[0] * (LONGEST - len(gram)), n] for gram, n in items]
        return cls.build(np.array(rows, np.int64).reshape(-1, LONGEST + 1), words)

    def rows(self) -> np.ndarray:
        """All n-grams as rows of word numbers from 1 and a count, by length: a level of arcs at a time."""
        arc, before, out = np.arange(self.first[-2], self.first[-1]), np.zeros((self.first[-1] - self.first[-2], 0), np.int64), [np.zeros((0, LONGEST + 1), np.int64)]
        while len(arc):
            before = np.column_stack([before, self.symbol[arc] + 1])
            own = self.count[arc] > 0
            level = np.zeros((own.sum(), LONGEST + 1), np.int64)
            level[:, : before.shape[1]], level[:, LONGEST] = before[own], self.count[arc[own]]
            out.append(level)
            begin = self.first[self.target[arc]].astype(np.int64)
            size = self.first[self.target[arc] + 1] - begin
            of = np.repeat(np.arange(len(arc)), size)
            arc, before = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), before[of]
        return np.concatenate(out)

    def items(self) -> Iterator[tuple[tuple[str, ...], int]]:
        """All n-grams in order, with their counts."""
        rows = self.rows()
        for *gram, n in rows[in_order(rows)].tolist():
            yield tuple([self.words[x - 1] for x in gram if x]), n

    def compose(self, parts: list[tuple[str, ...]]) -> list[int]:
        """The counts of sorted n-grams (0 for those that aren't there), walking both in step: what neighbours share is walked once."""
        number = {w: k for k, w in enumerate(self.words)}
        last, states, out = (), [len(self.first) - 2], []
        counts: list[int] = []
        for part in parts:
            same = 0
            while same < len(last) and same < len(part) and last[same] == part[same]:
                same += 1
            del states[same + 1 :], counts[same:]
            for w in part[same:]:
                state, s, n = states[-1], number.get(w, -1), 0
                if state >= 0 and s >= 0:
                    low, high = self.first[state], self.first[state + 1]
                    arc = low + int(np.searchsorted(self.symbol[low:high], s))
                    found = arc < high and self.symbol[arc] == s
                    state, n = (int(self.target[arc]), int(self.count[arc])) if found else (-1, 0)
                else:
                    state = -1
                states.append(state)
                counts.append(n)
            out.append(counts[len(part) - 1])
            last = part
        return out

    def pack(self) -> bytes:
        told = "\n".join(self.words).encode()
        narrow = self.count.astype(np.uint32) if self.count.max(initial=0) < 1 << 32 else self.count
        return struct.pack("<QIII", len(told), len(self.first), len(self.symbol), narrow.itemsize) + told + self.first.tobytes() + self.symbol.tobytes() + self.target.tobytes() + narrow.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        told, states, arcs, size = struct.unpack_from("<QIII", raw)
        at, parts = 20 + told, []
        for kind, n in (("<i4", states), ("<i4", arcs), ("<i4", arcs), (f"<{'u4' if size == 4 else 'i8'}", arcs)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        return cls(raw[20 : 20 + told].decode().split("\n") if told else [], parts[0], parts[1], parts[3].astype(np.int64), parts[2])


def in_order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows[:, LONGEST - 1 :: -1].T)


def united(parts: list[Transducer], least: int = 1) -> Transducer:
    """All n-grams of the parts, weights summed, without those below `least`: their arcs are numbered alike, put in order and added up."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: k for k, w in enumerate(words, 1)}
    every = [np.zeros((0, LONGEST + 1), np.int64)]
    for p in parts:
        rows = p.rows()
        rows[:, :LONGEST] = np.array([0, *(number[w] for w in p.words)])[rows[:, :LONGEST]]
        every.append(rows)
    rows = np.concatenate(every)
    rows = rows[in_order(rows)]
    if len(rows):
        begin = np.flatnonzero(np.append(True, (rows[1:, :LONGEST] != rows[:-1, :LONGEST]).any(axis=1)))
        total = np.add.reduceat(rows[:, LONGEST], begin)
        rows = rows[begin]
        rows[:, LONGEST] = total
        rows = rows[total >= least]
    return Transducer.build(rows, words)


class Buckets:
    """Counts of hashes by bucket, up to a limit of a byte."""

    def __init__(self, bits: int, limit: int, width: int):
        self.shift, self.limit, self.width = np.uint64(64 - bits), limit, width
        self.counts = np.zeros(1 << bits, np.uint8)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append((hashes >> self.shift).astype(np.uint32))
        self.size += len(hashes)
        if self.size > 2_000_000:
            self.settle()

    def settle(self) -> None:
        if self.held:
            bucket, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[bucket] = np.minimum(self.counts[bucket] + np.minimum(n, self.limit), self.limit)
            self.held, self.size = [], 0

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(slice, counts), those of few buckets as their places and counts."""
        self.settle()
        for k in range(0, len(self.counts), self.width):
            part = self.counts[k : k + self.width]
            own = np.flatnonzero(part)
            if len(own):
                yield k // self.width, part.tobytes() if 3 * len(own) > len(part) else own.astype(np.uint16).tobytes() + part[own].tobytes()


def dense(raw: bytes, size: int) -> np.ndarray:
    if len(raw) == size:
        return np.frombuffer(raw, np.uint8)
    n = len(raw) // 3
    out = np.zeros(size, np.uint8)
    out[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.uint8, n, 2 * n)
    return out


def frequent(docs: DataFrame, least: int, word_bits: int, bits: int, every: int, none: str) -> tuple[dict[int, np.ndarray], list[tuple[str, str, str]]]:
    """Which buckets of words (0) and pairs (1) have counts of `least` or more, one bit each, and a sample (language, word, next word) of one in `every`."""
    limit = min(least, 255)
    sizes = {0: min(SLICE, 1 << word_bits), 1: min(SLICE, 1 << bits)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {0: Buckets(word_bits, limit, sizes[0]), 1: Buckets(bits, limit, sizes[1])}
        told: list[tuple[int, int, bytes]] = []
        for words, langs in batches_of(batches, none):
            pairs = words.pairs()
            tables[0].add(words.hash)
            tables[1].add(pairs[words.follows])
            # one in so many places, whatever stands there
            for k in np.flatnonzero(words.follows & ((words.start * 2654435761 + words.doc) % every == 0)).tolist():
                told.append((2, 0, "\n".join((langs[words.doc[k]], words.word(k), words.word(k + 1))).encode()))
        give_back()
        for kind, table in tables.items():
            for place, raw in table.rows():
                told.append((kind, place, raw))
                if len(told) > 200:
                    yield record(told)
                    told = []
        yield record(told)

    def record(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["kind", "slice", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            out = []
            for kind, place, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if kind == 2:
                    out.append((2, 0, raw))
                    continue
                if at != (kind, place):
                    if at is not None:
                        out.append((*at, np.packbits(total >= limit).tobytes()))
                    at, total = (kind, place), np.zeros(sizes[kind], np.uint16)
                total = np.minimum(total + dense(raw, sizes[kind]), limit)
            if out:
                yield record(out)
        if at is not None:
            yield record([(*at, np.packbits(total >= limit).tobytes())])

    told = docs.mapInArrow(count, "kind int, slice int, raw binary")
    spread = F.when(F.col("kind") == 2, F.xxhash64("raw") % 64).otherwise(F.col("slice"))
    rows = told.repartition("kind", spread).sortWithinPartitions("kind", "slice").mapInArrow(add, "kind int, slice int, raw binary").collect()
    seen = {0: np.zeros((1 << word_bits) // 8, np.uint8), 1: np.zeros((1 << bits) // 8, np.uint8)}
    for r in rows:
        if r.kind < 2:
            part = np.frombuffer(r.raw, np.uint8)
            seen[r.kind][r.slice * SLICE // 8 : r.slice * SLICE // 8 + len(part)] = part
    return seen, [tuple(r.raw.decode().split("\n")) for r in rows if r.kind == 2]


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


class Ngrams:
    """Sorted rows of word numbers from 1 and a count."""

    def __init__(self, rows: np.ndarray, words: list[str]):
        self.rows, self.words = rows, words

    def __len__(self) -> int:
        return len(self.rows)

    def words_of(self, k: int) -> tuple[str, ...]:
        return tuple([self.words[x - 1] for x in self.rows[k, :LONGEST].tolist() if x])

    def before(self, words: tuple[str, ...]) -> int:
        """How many n-grams stand before this one."""
        return bisect_left(range(len(self)), words, key=self.words_of)


class Shard:
    """The words of some documents as numbers, 0 for those that are not frequent, and which pairs are frequent."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, words: Words, langs: list[str], seen: dict[int, np.ndarray]) -> None:
        chosen = np.flatnonzero(is_set(seen[0], words.hash))
        own = np.zeros(len(words) + 1, np.int32)
        if len(chosen):
            first, place = words.first_of(chosen)
            numbers = [self.number.setdefault((langs[words.doc[k]], words.word(k)), len(self.number) + 1) for k in first.tolist()]
            own[chosen] = np.array(numbers, np.int32)[place]
        pair = np.append(words.follows & (own[:-1] > 0) & (own[1:] > 0), False)
        at = np.flatnonzero(pair)
        if len(at):
            pair[at] = is_set(seen[1], pair_hash(words.hash[at], words.hash[at + 1]))
        self.parts.append((own, pair))
        self.size += len(words)

    def ngrams(self) -> Iterator[tuple[str, Ngrams]]:
        """(language, its n-grams in order with their counts)."""
        t = np.concatenate([p[0] for p in self.parts]).astype(np.int64)
        two = np.concatenate([p[1] for p in self.parts])
        grams: list[np.ndarray] = []

        def take(columns: list[np.ndarray], n: np.ndarray) -> None:
            grams.append(np.stack([*columns, *[np.zeros(len(n), np.int64)] * (LONGEST - len(columns)), n], axis=1).astype(np.int32))  # a shard's counts are small

        names = sorted(self.number)  # by language, then word
        rank = np.zeros(len(names) + 1, np.int64)
        rank[[self.number[x] for x in names]] = np.arange(1, len(names) + 1)
        t = rank[t]
        n = np.bincount(t, minlength=len(names) + 1)
        take([np.flatnonzero(n[1:]) + 1], n[np.flatnonzero(n[1:]) + 1])
        at = np.flatnonzero(two)
        if len(at):
            code, place, n = np.unique(t[at] << 32 | t[at + 1], return_inverse=True, return_counts=True)
            left, right = code >> 32, code & 0xFFFFFFFF
            take([left, right], n)
            pair = np.zeros(len(t), np.int64)
            pair[at] = place
            at = at[two[at + 1]]
            code, n = np.unique(pair[at] << 32 | t[at + 2], return_counts=True)
            take([left[code >> 32], right[code >> 32], code & 0xFFFFFFFF], n)
            at = at[two[at + 2]]
            code, n = np.unique(pair[at] << 32 | pair[at + 2], return_counts=True)
            a, b = code >> 32, code & 0xFFFFFFFF
            take([left[a], right[a], left[b], right[b]], n)
        rows = np.concatenate(grams)
        rows = rows[in_order(rows)]
        self.parts, self.number = [], {}  # what the rows hold isn't held twice
        langs = [x[0] for x in names]
        words = [x[1] for x in names]
        begin = 0
        while begin < len(rows):
            lang = langs[rows[begin, 0] - 1]
            end = int(np.searchsorted(rows[:, 0], bisect_right(langs, lang), "right"))
            yield lang, Ngrams(rows[begin:end], words)
            begin = end


def counted(docs: DataFrame, seen: dict[int, np.ndarray], bounds: list[tuple[str, ...]], none: str) -> DataFrame:
    """(range, lang, n, automaton): of each shard a transducer for each language and range, and its words by language (range -1)."""
    told = docs.sparkSession.sparkContext.broadcast((seen, bounds))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, cuts = told.value
        release()
        total: dict[str, int] = {}

        def tell(shard: Shard) -> Iterator[pa.RecordBatch]:
            for lang, items in shard.ngrams():
                places = [0, *(items.before(b[1:]) for b in cuts if b[0] == lang), len(items)]
                base = bisect_left(cuts, (lang,))
                for k, (x, y) in enumerate(zip(places, places[1:], strict=False)):
                    if x < y:
                        yield record(base + k, lang, y - x, Transducer.build(items.rows[x:y], items.words).pack())

        shard = Shard()
        for words, langs in batches_of(batches, none):
            for k, n in enumerate(np.bincount(words.doc, minlength=len(langs)).tolist()):
                if n:
                    total[langs[k]] = total.get(langs[k], 0) + n
            shard.add(words, langs, bits)
            if shard.size >= SHARD:
                yield from tell(shard)
                shard = Shard()
        if shard.parts:
            yield from tell(shard)
        for lang, n in total.items():
            yield record(-1, lang, n, None)
        give_back()

    return docs.mapInArrow(over, "range int, lang string, n long, automaton binary")


def record(place: int, lang: str, n: int, raw: bytes | None) -> pa.RecordBatch:
    return pa.record_batch([pa.array([place], pa.int32()), pa.array([lang]), pa.array([n], pa.int64()), pa.array([raw], pa.binary())], names=["range", "lang", "n", "automaton"])


def union(shards: DataFrame, least: int) -> DataFrame:
    """The shards' transducers of each language and range as one, with weights of `least` or more; of range -1, words by language."""

    def over(group: pa.Table) -> pa.Table:
        place, lang = group.column("range")[0].as_py(), group.column("lang")[0].as_py()
        if place < 0:
            return pa.Table.from_batches([record(-1, lang, pc.sum(group.column("n")).as_py(), None)])
        parts = [Transducer.unpack(x.as_py()) for x in group.column("automaton")]
        whole = united(parts, least)
        return pa.Table.from_batches([record(place, lang, len(whole.symbol), whole.pack())])

    return shards.groupBy("range", "lang").applyInArrow(over, "range int, lang string, n long, automaton binary")


def range_of(bounds: list[tuple[str, ...]], key: tuple[str, ...]) -> int:
    """The range of (language, words...): as `counted` numbers them."""
    return bisect_right(bounds, key)


def ngram_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", none: str = "und") -> tuple[DataFrame, list[tuple[str, ...]]]:
    """The written table (range, lang, n, automaton) of all n-grams with counts of `least` or more, and the bounds of its ranges."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    words = (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5 + 1
    bits = min(BITS, max(16, words.bit_length()))
    ranges = min(RANGES, words // (8 * RANGE) + 1)
    seen, sample = frequent(own, least, min(WORD_BITS, bits), bits, max(1, words // (ranges * SAMPLED)), none)
    sample.sort()
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if len(sample) > ranges else []
    return written(union(counted(own, seen, cuts, none), least), "ngrams"), cuts


def looked_up(parts: DataFrame, table: DataFrame, bounds: list[tuple[str, ...]]) -> DataFrame:
    """(lang, phrase, f) for distinct phrases (lang, phrase), by composing those of a range with its transducer."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [range_of(bounds, (n, *p.split(" "))) for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], names=["range", "lang", "phrase"])

    def over(asked: pa.Table, known: pa.Table) -> pa.Table:
        wanted = sorted(tuple(p.split(" ")) for p in asked.column("phrase").to_pylist())
        counts = [0] * len(wanted)
        for raw in known.column("automaton"):
            counts = Transducer.unpack(raw.as_py()).compose(wanted)
        name = asked.column("lang")[0].as_py() if len(wanted) else ""
        return pa.table({"lang": pa.array([name] * len(wanted), pa.string()), "phrase": pa.array(map(" ".join, wanted), pa.string()), "f": pa.array(counts, pa.int64())})

    placed = parts.select("lang", "phrase").mapInArrow(place, "range int, lang string, phrase string")
    return placed.groupBy("range", "lang").cogroup(table.where("range >= 0").groupBy("range", "lang")).applyInArrow(over, "lang string, phrase string, f long")


def mine(docs: DataFrame, least: int = 30, scale: int = 2_000_000, inside: int = 80, most: int = 2000, text: str = "text", lang: str = "lang", none: str = "und") -> DataFrame:
    """Each language's first `most` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A phrase with a count `a` of `least` or more is cut behind its first k words into parts with counts l and r, scored
    floor(scale * a / (l + r)); the cut of the lowest score counts, of the smallest k among equals. Phrases that
    stand within a longer one with at least `inside` percent of their count go. The order is score and a descending, then the phrase.
    """
    table, bounds = ngram_counts(docs, least, text, lang, none)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(" ".join(w), n) for w, n in Transducer.unpack(raw.as_py()).items() if len(w) > 1]
                if found:
                    yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.int64())], names=["lang", "phrase", "a"])

    found = table.where("range >= 0").select("lang", "automaton").mapInArrow(phrases, "lang string, phrase string, a long")
    found = written(found.withColumn("w", F.split("phrase", " ")), "phrases")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("right"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("part")), F.struct(F.lit(1).alias("side"), F.col("right").alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    counts = looked_up(sides.select("lang", F.col("part").alias("phrase")).distinct(), table, bounds)
    told = sides.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("score", F.call_function("div", (exact("a") * F.lit(scale).cast("decimal(10,0)")), (exact("l") + exact("r"))))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    length = F.size("w")
    longer = found.where(length > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), length - 1)).alias("m")).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), length - F.col("m") + 1)).alias("i"))
    longer = longer.groupBy("lang", F.array_join(F.expr("slice(w, i, m)"), " ").alias("phrase")).agg(F.max("a").alias("held"))
    kept_ones = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(exact("held") * 100 < exact("a") * inside, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept_ones.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    total = table.where("range < 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
