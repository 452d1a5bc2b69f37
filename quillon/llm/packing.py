"""Packing: training windows of a fixed capacity by multiway differencing.

Each document's token ids are cut into pieces: as many full windows as they fill, each a sequence of its own,
and one remainder. Remainders are dealt out to blocks of about `BLOCK` documents, and each block is split into
near-equal windows by Karmarkar-Karp differencing: the two partial partitions with the widest spread are
merged, largest loads against smallest, until one is left. If a window exceeds the capacity, the block is
split anew into one window more.

Defined results: a null text is an empty one, whose one piece is the end id; repeated rows and repeated ids
are packed as often as they stand there; whole texts are packed; a block holds about as many rows whatever
the ids are, as rows are dealt out by id and place; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._common import kept, map_arrow

#: Documents in a block, on average.
BLOCK = 1024
#: Words whose ids each Python worker keeps; later ones are encoded anew each time.
KEPT_WORDS = 600_000
#: Words that are encoded at once: the library's results are many times larger than the ids.
NEW_WORDS = 2_000
#: Characters of text whose words are held at once.
HELD_CHARS = 2_000_000
#: Latin-1 letters in lower case, numbers and white space, and the words that the vocabulary's file splits at.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids by the tokenizers library; within Latin-1, texts are split here and each new word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or r"(?!)")
        try:
            self.by_word = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT and [n["type"] for n in told["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        except (KeyError, TypeError, IndexError):
            self.by_word = False
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        held: list[list[str] | bytes] = []
        chars = 0
        for text in texts:
            plain = self.by_word and not self.marks.search(text)
            if plain:
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    plain = False
            held.append(LATIN.findall(text.lower()) if plain else self.whole(text))
            chars += len(text)
            if chars > HELD_CHARS:
                yield from self.joined(held)
                held, chars = [], 0
        yield from self.joined(held)

    def joined(self, held: list[list[str] | bytes]) -> Iterator[bytes]:
        words = self.words
        new = list(set().union(*(x for x in held if isinstance(x, list))).difference(words))
        if len(words) + len(new) > KEPT_WORDS:
            words.clear()
            new = list(set().union(*(x for x in held if isinstance(x, list))))
        for k in range(0, len(new), NEW_WORDS):
            part = new[k : k + NEW_WORDS]
            for word, told in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                words[word] = np.array(told.ids, "<u4").tobytes()
        for x in held:
            yield x if isinstance(x, bytes) else b"".join(map(words.__getitem__, x))


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return kept(lambda: Encoder(path), "encoder", path)


def differencing(lengths: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(load, items) of each non-empty window. A partial partition holds its non-empty windows, smallest load first."""
    heap = [(-n, k, [(n, [k])]) for k, n in enumerate(lengths)]
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        clash = max(0, len(a) + len(b) - windows)  # so many windows of each have no empty one to face
        met = [(x + y, p + q) for (x, p), (y, q) in zip(a[:clash], b[clash - 1 :: -1] if clash else [], strict=False)]
        merged = sorted(met + a[clash:] + b[clash:], key=lambda w: w[0])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    return heap[0][2] if heap else []


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each window, none above the capacity: near-equal loads, in as few windows as differencing manages."""
    windows = max(1, math.ceil(sum(lengths) / capacity))
    while True:
        split = differencing(lengths, windows)
        most = max((load for load, _ in split), default=0)
        if most <= capacity:
            return [items for _, items in split]
        windows += 1


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, blocks: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's pieces with the block that packs them: full windows and one remainder."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_pylist()
        out: dict[str, list] = {n: [] for n in (key, "start", "length", "ids_crc32", "doc_tokens", "block")}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for place, (k, ids) in enumerate(zip(keys, encoder(path).encode(texts), strict=True)):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                for name, value in zip(out, (k, start, len(piece) // 4, zlib.crc32(piece), total, zlib.crc32(f"{k}:{place}".encode()) % blocks), strict=True):
                    out[name].append(value)
        return pa.record_batch([pa.array(v, batch.schema.field(0).type if n == key else pa.int64()) for n, v in out.items()], names=list(out))

    return map_arrow(docs.select(key, text), over, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, block long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: its document's key, start, length, ids_crc32, doc_tokens, and sequence_id and offset where it lies."""
    blocks = max(1, math.ceil(docs.count() / BLOCK))
    cut = pieces(docs, path, capacity, end_id, blocks, text, key)

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([key, "start", "ids_crc32"], kind="stable", ignore_index=True)
        length = block["length"].to_numpy()
        sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        full = np.flatnonzero(length == capacity)
        sequence[full] = np.arange(len(full))
        rest = np.flatnonzero(length < capacity)
        for k, items in enumerate(windows_of(length[rest].tolist(), capacity)):
            at = rest[items]
            sequence[at] = len(full) + k
            offset[at] = np.cumsum(length[at]) - length[at]
        block["sequence_id"] = (block["block"].to_numpy() << 32) + sequence
        block["offset"] = offset
        return block.drop(columns="block")

    kind = dict(docs.dtypes)[key]
    return cut.groupBy("block").applyInPandas(place, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
