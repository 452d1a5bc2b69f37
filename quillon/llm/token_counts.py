"""Token counts: exact byte-level BPE counts at every prefix by dynamic programming.

A byte-pair encoding is right exactly when each two neighbours in it are what encoding their joined
bytes gives. So each prefix of a word has one last token that fits behind the encoding of what stands
before it, and its count is that shorter prefix's plus one. `Words` keeps these counts for every prefix of
every word met, `Prefixes` adds them up over a text: the count of any prefix, and the longest prefix within
a budget, follow from the stored arrays without encoding again.

Defined results: a null text counts as empty, an empty text has no tokens; the strings of special tokens
in a text are those tokens, as the library reads them by default; repeated rows and repeated ids give one
row each; whole texts are counted, whatever their length; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm._common import kept, map_arrow

#: The word pattern of byte-level BPE, and for Latin-1 its letters, numbers and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = r"\t-\r \x85\xa0"

ANY = regex.compile(PATTERN)
#: The same words for texts within Latin-1, twice as fast.
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

#: Words whose prefix counts each Python worker keeps, and their characters in all; later ones are counted anew each time.
KEPT_WORDS, KEPT_CHARS = 600_000, 16_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words(dict):
    """word -> its token count; a word not met before is counted by the prefix recurrence, and the counts of its prefixes kept."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        super().__init__()
        byte = {letter: b for b, letter in byte_letters().items()}
        raw = lambda t: bytes(byte[c] for c in t)
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in merges]
        #: Each pair that merges, and when; each token's two halves; each token's own time, bytes first.
        self.time = {pair: k for k, pair in enumerate(pairs)}
        self.halves = {left + right: (left, right) for left, right in pairs}
        self.names = [raw(t) for t in vocabulary if all(c in byte for c in t)]
        self.born = {name: self.time[self.halves[name]] if name in self.halves else -1 for name in self.names}
        #: A tree of the tokens' bytes; -1 leads to the place of a token that ends there.
        self.tree: dict = {}
        for k, name in enumerate(self.names):
            node = self.tree
            for b in name:
                node = node.setdefault(b, {})
            node[-1] = k
        self.longest = max(map(len, self.names), default=1)
        self.fits: dict[int, bool] = {}
        #: word -> the token counts of its prefixes by characters.
        self.held: dict[str, bytes | array] = {}
        self.room = KEPT_CHARS

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether encoding left + right gives just these two tokens.

        Undo the merges that face the border, latest first. The two don't fit if the pieces there would have
        merged across it before the merge undone last on either side.
        """
        limit = 1 << 60
        while True:
            if self.time.get((left, right), limit) < limit:
                return False
            a, b = self.born[left], self.born[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                # merges of equal time go from the left, so one on the left side comes before a crossing one
                left, limit = self.halves[left][1], a
            else:
                right, limit = self.halves[right][0], b + 1

    def prefixes(self, word: bytes) -> list[int]:
        """The token count of word[:n] for n from 0 to its length."""
        counts, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        tree, fits = self.tree, self.fits
        for start in range(len(word)):
            node, end, before, count = tree, start, last[start] << 20, counts[start] + 1
            for b in word[start : start + self.longest]:
                node = node.get(b)
                if node is None:
                    break
                end += 1
                # one token at most fits at each end, so an end that has one needs no other
                if last[end] < 0 and -1 in node:
                    token = node[-1]
                    if start:
                        known = fits.get(before | token)
                        if known is None:
                            if len(fits) > 1_000_000:
                                fits.clear()
                            known = fits[before | token] = self.fit(self.names[last[start]], self.names[token])
                        if not known:
                            continue
                    counts[end], last[end] = count, token
        return counts

    def __missing__(self, word: str) -> int:
        return self.within(word)[-1]

    def within(self, word: str) -> bytes | array:
        """The token count of the first n characters of a word for n from 0 to its length."""
        known = self.held.get(word)
        if known is None:
            counts = self.prefixes(word.encode("utf-8", "surrogatepass"))
            if not word.isascii():
                counts = [counts[n] for n in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in word), initial=0)]
            # a prefix that ends within a character's bytes has no part here; counts mostly fit one byte
            known = bytes(counts) if max(counts) < 256 else array("I", counts)
            if len(self.held) < KEPT_WORDS and len(word) <= self.room:
                self.held[word], self[word] = known, known[-1]
                self.room -= len(word)
        return known


class Prefixes:
    """The token count of every prefix of one text: word ends, the running count there, and within words on demand."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        self.words = counter.split(text)
        self.ends = list(accumulate(map(len, self.words)))
        self.counts = list(accumulate(map(counter.cost, self.words)))

    @property
    def total(self) -> int:
        return self.counts[-1] if self.counts else 0

    def at(self, chars: int) -> int:
        """The token count of the first `chars` characters, as encoding them alone gives it."""
        if chars >= len(self.text):
            return self.total
        k = bisect_right(self.ends, chars)  # words that end at or before the cut
        low = self.ends[k - 1] if k else 0
        if chars - low >= self.least(k):
            return (self.counts[k - 1] if k else 0) + self.counter.words.within(self.words[k])[chars - low]
        while k and (self.words[k - 1].isspace() or self.ends[k - 1] == chars or self.counter.special_near(self.text, self.ends[k - 1], chars)):
            k -= 1
        start = self.ends[k - 1] if k else 0
        return (self.counts[k - 1] if k else 0) + sum(map(self.counter.cost, self.counter.split(self.text[start:chars])))

    def least(self, k: int) -> int:
        """From how many characters on a cut within word k leaves the words before it and the first part of it as words."""
        word = self.words[k]
        if word in self.counter.special or word[0] == "'" and len(word) <= 3:  # of these, parts are split otherwise
            return len(word) + 1
        return 2  # a first space can belong to white space before it

    def fit(self, budget: int) -> int:
        """The characters of the longest prefix whose tokens, encoded alone, stay within the budget."""
        if self.total <= budget:
            return len(self.text)
        # the first word that crosses it; the cut lies there, one character behind (white space is split by what follows), or before
        for k in range(bisect_right(self.counts, budget), -1, -1):
            low, end = self.ends[k - 1] if k else 0, self.ends[k]
            for cut in range(min(end + 1, len(self.text)), end - 1, -1):
                if self.at(cut) <= budget:
                    return cut
            before, least, told = self.counts[k - 1] if k else 0, self.least(k), None
            if end - low > least:
                told = self.counter.words.within(self.words[k])
                for n in range(end - low - 1, least - 1, -1):
                    if before + told[n] <= budget:
                        return low + n
            for cut in range(min(end - 1, low + least - 1), low - 1, -1):
                if self.at(cut) <= budget:
                    return cut
        return 0


class Counter:
    """Splits texts as the tokenizer's file says and counts through `Words`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["model"]["type"] != "BPE" or told.get("normalizer") or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser or prefix space is counted")
        self.special = {t["content"] for t in told["added_tokens"]}
        self.words = Words(told["model"]["vocab"], told["model"]["merges"])
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        if self.marks and self.marks.search(text):
            return [w for part in self.marks.split(text) for w in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return ANY.findall(text)
        return LATIN.findall(text)

    def cost(self, word: str) -> int:
        return 1 if word in self.special else self.words[word]

    def special_near(self, text: str, start: int, end: int) -> bool:
        """Whether a cut before `start` could see a special token that a cut at `end` breaks, or the reverse."""
        return any(s.startswith(text[start:end]) for s in self.special) if end - start < 64 and text[start:end].startswith("<") else False

    def total(self, text: str) -> int:
        """The token count of a whole text: the last of its prefix counts."""
        if self.marks and self.marks.search(text):
            return sum(map(self.cost, self.split(text)))
        return sum(map(self.words.__getitem__, self.plain(text)))


def counter(path: str) -> Counter:
    """One for each Python worker and file."""
    return kept(lambda: Counter(path), "counter", path)


def prefix_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ends, counts): for each document the ends of its words, in characters, and the token count of the prefix up to each."""
    kind = dict(docs.dtypes)[key]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [Prefixes(t or "", counter(path)) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([m.ends for m in made], pa.list_(pa.int32())), pa.array([m.counts for m in made], pa.list_(pa.int32()))], names=[key, "ends", "counts"])

    return map_arrow(docs.select(key, text), over, f"{key} {kind}, ends array<int>, counts array<int>")


def token_counts(docs: DataFrame, path: str, budget: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: n_bytes, n_tokens, over_limit, and kept_chars, the longest prefix within the budget in characters.

    The counts come from the prefix arrays, made in the task that holds the text; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[key]

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n_tokens = [count.total(t) for t in texts]
        n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        kept = [len(t) if n <= budget else Prefixes(t, count).fit(budget) for t, n in zip(texts, n_tokens, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens]), pa.array(kept, pa.int64())], names=[key, "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    return map_arrow(docs.select(key, text), over, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
