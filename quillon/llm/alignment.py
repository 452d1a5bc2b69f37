"""Cross-tokenizer alignment: the ends of two token sequences, merged along equal pieces of the merge path.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes. Where tokens of both end together, a group
ends. The ends of A and of B are two sorted lists; `merged` cuts their merge into pieces of equal work: for each
diagonal of the merge grid a binary search finds how many elements of either list come before it, so pieces are
independent of each other. Each piece emits the common ends that it holds and the tokens before and after them; groups
that cross a border are stitched from the two pieces beside it.

Texts are cut into units (white space and the word behind it), which neither vocabulary's tokens cross; the ends of all
new units of a batch are merged at once, and each worker keeps what units it has seen. Counts of linked id pairs are
summed over the corpus: blocks of documents are written with their pairs packed, (block, pair, n) rows are counted and
joined with the counts, and each block meets its answers again. No table of counts is broadcast.

Defined results: texts that are null or empty, or whose tokens do not give back space + text, have no tokens: zeros and
an empty groups_sha256. Repeated rows and ids give one row each and count as often; whole texts are aligned, and
one of a size that units don't divide is encoded as a whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BATCH_BYTES, cut, give_back, kept, small_batches, written
from quillon.llm.token_counts import byte_letters

#: Ends of both lists in a piece of the merge path.
WORK = 4096
#: Units that each worker keeps, and characters of the longest that is kept.
KEPT_UNITS, KEPT_CHARS = 400_000, 48
#: Units that are encoded at once.
NEW_UNITS = 20_000
#: Bytes of texts in a block, about; ids of either vocabulary are below IDS, so that a pair fits 32 bits.
BLOCK_BYTES, IDS = 24 << 20, 1 << 16


def diagonal(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many elements of a stand among the first `at` ones of the merge of a and b (of equals, a's comes first): a binary search for all diagonals at once."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        # a[middle] comes before b[at - 1 - middle]: more of a stand before the diagonal
        more = np.zeros(len(at), bool)
        open_ = low < high
        more[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    return low


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """For each group in order, how many of a's and of b's tokens lie up to its end; a and b are the sorted ends of the tokens."""
    at = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    i = diagonal(a, b, at)
    j = at - i
    # a common end whose two copies a border parts belongs to the piece before: b's copy comes second
    parted = (i > 0) & (j < len(b))
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    j = j + parted
    pieces = [piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]) for k in range(len(at) - 1)]
    return stitched(pieces)


def piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of one piece, the tokens of each side from one common end to the next, and those behind the last one."""
    place = np.searchsorted(b, a)
    common = place < len(b)
    common[common] = b[place[common]] == a[common]
    x = np.flatnonzero(common) + 1
    y = place[common] + 1
    return np.diff(x, prepend=0), np.diff(y, prepend=0), len(a) - int(x[-1] if len(x) else 0), len(b) - int(y[-1] if len(y) else 0)


def stitched(pieces: list[tuple[np.ndarray, np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all pieces: the first group of each takes what the pieces before left open."""
    left, right, open_a, open_b = [], [], 0, 0
    for x, y, rest_a, rest_b in pieces:
        if len(x):
            x, y = x.copy(), y.copy()
            x[0] += open_a
            y[0] += open_b
            left.append(x)
            right.append(y)
            open_a, open_b = rest_a, rest_b
        else:
            open_a, open_b = open_a + rest_a, open_b + rest_b
    empty = [np.zeros(0, np.int64)]
    return np.cumsum(np.concatenate(left or empty)), np.cumsum(np.concatenate(right or empty))


class Unit:
    """What a unit gives: whether both sides give back its bytes, tokens of either side, its groups as text, its links (unsigned 32-bit: the id of A times IDS plus that of B)."""

    __slots__ = ("ok", "n_a", "n_b", "groups", "links")

    def __init__(self, ok: bool, n_a: int, n_b: int, groups: bytes, links: bytes):
        self.ok, self.n_a, self.n_b, self.groups, self.links = ok, n_a, n_b, groups, links


class Aligner:
    """Both vocabularies, and the units met."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces_path)
        byte = {letter: k for k, letter in byte_letters().items()}
        size = self.a.get_vocab_size()
        if max(size, self.b.get_piece_size()) > IDS:
            raise ValueError("vocabularies of more than 65,536 ids are not aligned")
        self.a_bytes = [bytes(byte[c] for c in self.a.id_to_token(k) or "" if c in byte) for k in range(size)]
        told = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(told)]
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        #: White space that stands behind another character in a piece: texts with it aren't cut into units.
        plain = [p.lstrip("▁") for k, p in enumerate(told) if not self.b.is_byte(k)]
        glue = {c for p in plain if len(p) > 1 for c in p if c.isspace() or c == "▁"} | {c for p in told if p.startswith("▁") for c in p.lstrip("▁") if c.isspace()}
        self.whole = re.compile("[" + re.escape("".join(sorted(glue | {"▁"}))) + "\x1c-\x1f]")
        self.divided = " " not in glue and "\n" not in glue and self.b.encode("  a b\n c") == self.b.encode("  a") + self.b.encode("b") + self.b.encode("\n c")[1:]
        self.units: dict[str, Unit] = {}

    def split(self, text: str) -> list[str]:
        """space + text in units; only white space that no piece has behind a character begins one."""
        text = " " + text
        if not self.divided or self.whole.search(text):
            return [text]
        return UNITS.findall(text)

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for units as they stand within a text."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # of " " alone nothing is left to encode; before other white space the piece of the added space goes
        return a, [x or [self.space] if u[0] == " " else x[1:] if x[:1] == [self.space] else [] for u, x in zip(units, b, strict=True)]

    def learn(self, units: list[str]) -> list[Unit]:
        """Aligns units whose tokens give back their bytes, all of them in one merge."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        ids_a, ids_b = self.encoded(units)
        ok = [b"".join(map(self.a_bytes.__getitem__, x)) == r and b"".join(map(self.b_bytes.__getitem__, y)) == r for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        own = [k for k, good in enumerate(ok) if good]
        a = np.array([i for k in own for i in ids_a[k]], np.int64)
        b = np.array([i for k in own for i in ids_b[k]], np.int64)
        x, y = merged(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        links = (a[x - 1] * IDS + b[y - 1]).astype(np.uint32)
        out = [Unit(False, 0, 0, b"", b"")] * len(units)
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ends_a, ends_b = x.tolist(), y.tolist()
        told, i, j = [], 0, 0
        for p, q in zip(ends_a, ends_b, strict=True):
            told.append(f"{','.join(names_a[i:p])}|{','.join(names_b[j:q])}")
            i, j = p, q
        group, seen = 0, 0
        for k in own:  # a unit ends with a group: both sides' tokens end there
            seen += len(ids_a[k])
            last = int(np.searchsorted(x, seen)) + 1
            out[k] = Unit(True, len(ids_a[k]), len(ids_b[k]), ";".join(told[group:last]).encode(), links[group:last].tobytes())
            group = last
        return out

    def align(self, texts: list[str]) -> Iterator[tuple[list[Unit], bool]]:
        """The units of each text, and whether all of them give back their bytes."""
        split = [self.split(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.units)) if split else []
        if len(self.units) + len(new) > KEPT_UNITS:
            self.units.clear()
            new = list(set().union(*split))
        own: dict[str, Unit] = {}
        for k in range(0, len(new), NEW_UNITS):
            part = new[k : k + NEW_UNITS]
            own.update(zip(part, self.learn(part), strict=True))
        self.units.update((u, x) for u, x in own.items() if len(u) <= KEPT_CHARS)
        for words in split:
            found = [own.get(w) or self.units[w] for w in words] if own else list(map(self.units.__getitem__, words))
            yield found, bool(found) and all([u.ok for u in found])


UNITS = re.compile(r"\s*\S+|\s+")


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One for each Python worker and pair of files."""
    return kept(lambda: Aligner(bytes_path, pieces_path), "aligner", bytes_path, pieces_path)


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(block, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each document's alignment, with its linked pairs and how often it holds each, packed: 4 bytes a pair, and 1, 2 or 4 for its times."""
    kind = dict(docs.dtypes)[key]
    names = ["block", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = (TaskContext.get().partitionId() << 24), 0
        for whole in batches:
            for batch in cut(whole, BATCH_BYTES):
                out: dict[str, list] = {n: [] for n in names[2:]}
                for units, ok in aligner(bytes_path, pieces_path).align([t or "" for t in batch.column(1).to_pylist()]):
                    if not ok:
                        units = []
                    links = np.frombuffer(b"".join([u.links for u in units]), np.uint32)
                    pairs, times = np.unique(links, return_counts=True)
                    sha = hashlib.sha256(b";".join([u.groups for u in units])).hexdigest() if units else ""
                    for n, v in zip(names[2:], (sum([u.n_a for u in units]), sum([u.n_b for u in units]), len(links), len(links), sha, pairs.tobytes(), times.astype(np.min_scalar_type(max(times.max(initial=0), 1))).tobytes()), strict=True):
                        out[n].append(v)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array([block] * batch.num_rows, pa.int64()), batch.column(0), *(pa.array(out[n], k) for n, k in zip(names[2:], kinds, strict=True))], names=names)
                held += batch.nbytes
                if held > BLOCK_BYTES:
                    block, held = block + 1, 0
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(over, f"block long, {key} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def unpacked(pairs: pa.BinaryScalar, times: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(pairs.as_buffer(), np.uint32)
    raw = times.as_buffer()
    return pair, np.frombuffer(raw, f"u{raw.size // len(pair)}" if len(pair) else "u1").astype(np.int64)


def packed_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): the linked pairs of each block of documents; a pair may have several rows of a block that more tasks read."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs, times, held = None, [], [], 0

        def tell() -> Iterator[pa.RecordBatch]:
            found, place = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(found), block), pa.int64()), pa.array(found.astype(np.int64)), pa.array(n)], names=["block", "pair", "n"])
            pairs.clear()
            times.clear()

        for batch in batches:
            for own, p, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if pairs and (own != block or held > 1 << 22):
                    yield from tell()
                    held = 0
                block = own
                pair, n = unpacked(p, t)
                pairs.append(pair)
                times.append(n)
                held += len(pair)
        if pairs:
            yield from tell()
        give_back()

    return blocks.select("block", "pairs", "times").mapInArrow(over, "block long, pair long, n long")


def align(docs: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = written(aligned(docs, bytes_path, pieces_path, text, key), "alignment")
    kind = dict(docs.dtypes)[key]
    held = packed_pairs(blocks)
    counts = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", F.lit(IDS)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    told = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = held.select("block", "pair").join(told, "pair")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def over(group: pa.Table, found: pa.Table) -> pa.Table:
        pair = found.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], found.column("count").to_numpy()[order], found.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for p, t in zip(group.column("pairs"), group.column("times"), strict=True):
            own, times = unpacked(p, t)
            at = np.searchsorted(pair, own.astype(np.int64))
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([made.get(n, group.column(n) if n not in made else None) for n in names], names=names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(over, f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
