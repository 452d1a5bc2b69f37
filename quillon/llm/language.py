"""Language ID: cross-parsing entropy over suffix automata.

For each language a suffix automaton holds every substring of a bounded sample of its labelled texts. A text is
parsed with it into phrases, each the longest match from where the last one ended; unseen characters are phrases
of their own. Phrases times log2 of the sample's length, for each character, are bits; the language that needs
fewest wins. Reading is a walk over a table (state, character) -> (state, phrases ended), so that many blocks of
text are parsed at once, by all languages. Blocks are only a way to walk: each begins in the state that the one before
it ends in, which is guessed from a few characters before it, checked, and walked anew where the guess was wrong.

Texts are lower-cased and everything but letters becomes one space. Each letter of the samples has a spelling of its own
in a small alphabet: one symbol for most, a row of symbols for the rare ones of large scripts. `score` is 1 - bits / bits
of the next language (1 with one language).

Defined results: null texts, texts without a letter, and all texts where nothing could be learned are `und` with
score 0; ties go to the language that sorts first; rows with a null language are not learned from; repeated rows
give one row each; whole texts are read, however long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._common import kept, map_arrow

#: Characters learned from in all and for each language at most, and rows of a language from which whole texts are taken.
LEARNED, LEARNED_EACH, ROWS = 240_000, 60_000, 200
#: Characters that any language may have, however many there are; slices of a language that has no whole text which fits.
LEAST_EACH, SLICES = 1_000, 4
#: Symbols at most, and letters with one of their own where there are more letters than that.
SYMBOLS, FREQUENT = 64, 44
#: Characters of a block, those before it from which its first state is guessed, and rounds in which wrong guesses are walked anew together.
BLOCK, WARM, ROUNDS = 2048, 64, 4
#: Symbols that are walked at once; rows and bytes of a batch: what a worker holds beside its table is a few times this.
HELD, ROWS_HELD, BYTES_HELD = 1_000_000, 250, 1 << 20
NONE = "und"


def spelled(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def automaton(symbols: bytes, width: int, table: memoryview) -> int:
    """The suffix automaton of a string, written to a table: rows of states, columns of symbols, -1 where there is no step; the number of states. State 0 is the start."""
    none = array("i", [-1]) * width
    table[:width] = none
    link, length, last, states = array("i", [-1]), array("i", [0]), 0, 1
    for c in symbols:
        new, states = states, states + 1
        table[new * width : states * width] = none
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and table[p * width + c] < 0:
            table[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = table[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy, states = states, states + 1
                table[copy * width : states * width] = table[q * width : (q + 1) * width]
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and table[p * width + c] == q:
                    table[p * width + c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return states


class Languages:
    """The tables of all languages, one behind the other. Cells: 4 * (cell of the next state) + phrases ended."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        points = {n: spelled(samples[n]) for n in self.names}
        self.spell(np.concatenate([*points.values(), np.zeros(0, np.uint32)]))
        texts = {n: self.symbols(points[n]) for n in self.names}
        width = self.width
        # room for all that could be; pages that no state needs are never touched
        self.table = np.empty(sum(2 * len(t) + 1 for t in texts.values()) * width, np.int32) if samples else None
        if self.table is not None and 4 * len(self.table) >= 1 << 31:
            raise ValueError("the samples are too large for the table")
        starts, logs, base = [], [], 0
        for n, text in texts.items():
            states = automaton(text.tobytes(), width, memoryview(self.table)[base:])
            own = self.table[base : base + states * width].reshape(states, width)
            root = own[0].copy()
            # where a match ends, the next phrase begins with the character at hand; unseen, that is one more phrase
            ends = np.where(root >= 0, 4 * (base + np.maximum(root, 0) * width) + 1, 4 * base + 2)
            for k in range(0, states, 4096):
                part = own[k : k + 4096]
                part[:] = np.where(part >= 0, 4 * (base + part * width), ends)
            own[0] = np.where(root >= 0, ends - 1, 4 * base + 1)
            starts.append(base)
            logs.append(np.log2(max(2, len(text))))
            base += states * width
        self.start, self.log = np.array(starts, np.int32), np.array(logs)

    def spell(self, points: np.ndarray) -> None:
        """Spellings of the letters among the samples' points: symbol 0 is a space, the last one any letter that no sample has."""
        seen, count = np.unique(points[letters()[points]], return_counts=True)
        seen = seen[np.lexsort((seen, -count))]
        short = seen if len(seen) <= SYMBOLS - 2 else seen[:FREQUENT]
        self.width = len(short) + 2 if len(seen) == len(short) else SYMBOLS
        self.symbol = np.where(letters(), self.width - 1, 0).astype(np.uint8)
        self.symbol[short] = np.arange(1, len(short) + 1)
        self.rare = seen[len(short) :]
        if len(self.rare):
            base, digits = SYMBOLS - 2 - FREQUENT, 1
            while base**digits < len(self.rare):
                digits += 1
            self.symbol[self.rare] = 255
            order = np.argsort(self.rare)
            self.rare = self.rare[order]
            self.digits = (FREQUENT + 1 + order[:, None] // base ** np.arange(digits) % base).astype(np.uint8)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """A text's symbols, each run of others than letters being one space."""
        k = self.symbol[points]
        k = k[(k > 0) | np.append(True, k[:-1] > 0)] if len(k) else k
        if len(self.rare) and (long := k == 255).any():
            n = self.digits.shape[1]
            own = self.digits[np.searchsorted(self.rare, points[self.symbol[points] == 255])]
            k = np.repeat(k, np.where(long, n, 1))
            k[k == 255] = own.ravel()
        return k

    def walk(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, phrases ended) of each language and block, from the states given on."""
        order = np.argsort(-size, kind="stable")
        first, sizes, state = begin[order], size[order], state[:, order]
        ended = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # blocks longer than each place
        for t, n in enumerate(active.tolist()):
            cell = self.table[state[:, :n] + data[first[:n] + t]]
            ended[:, :n] += cell & 3
            state[:, :n] = cell >> 2
        back = np.argsort(order)
        return state[:, back], ended[:, back]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts): phrases that each text's symbols need."""
        sizes = np.array([len(t) for t in texts])
        data = np.concatenate([*texts, np.zeros(0, np.uint8)])
        place = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        at = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin, size = place[text] + at * BLOCK, np.minimum(BLOCK, sizes[text] - at * BLOCK)
        entry = np.repeat(self.start[:, None], len(text), axis=1)
        later = np.flatnonzero(at)
        entry[:, later] = self.walk(data, begin[later] - WARM, np.full(len(later), WARM), entry[:, later])[0]
        state, ended = self.walk(data, begin, size, entry)
        for _ in range(ROUNDS):
            wrong = later[(entry[:, later] != state[:, later - 1]).any(axis=0)]
            if not len(wrong):
                break
            entry[:, wrong] = state[:, wrong - 1]
            state[:, wrong], ended[:, wrong] = self.walk(data, begin[wrong], size[wrong], entry[:, wrong])
        wrong = later[(entry[:, later] != state[:, later - 1]).any(axis=0)]
        for k in np.unique(text[wrong]).tolist():
            self.in_order(data, begin, size, np.flatnonzero(text == k), state, ended)
        out = np.zeros((len(self.names), len(texts)), np.int64)
        last = np.flatnonzero(np.diff(text, append=-1))
        for k in range(len(self.names)):
            out[k] = np.bincount(text, ended[k], len(texts))
            out[k, text[last]] += state[k, last] != self.start[k]
        return out

    def in_order(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, blocks: np.ndarray, state: np.ndarray, ended: np.ndarray) -> None:
        """One text's blocks, one after the other: long runs of one pattern keep wrong guesses wrong."""
        table = memoryview(self.table)
        for k, start in enumerate(self.start.tolist()):
            s = start
            for b in blocks.tolist():
                n = 0
                for c in data[begin[b] : begin[b] + size[b]].tolist():
                    cell = table[s + c]
                    n += cell & 3
                    s = cell >> 2
                state[k, b], ended[k, b] = s, n

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, bits for each character) of each text."""
        names, scores, bits = [NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        held: list[np.ndarray] = []
        places: list[int] = []

        def tell() -> None:
            if not held:
                return
            need = self.phrases(held) * self.log[:, None] / np.array([len(t) for t in held])
            best = need.argmin(axis=0)
            for j, p in enumerate(places):
                own = need[best[j], j]
                others = np.delete(need[:, j], best[j])
                names[p], bits[p] = self.names[best[j]], float(own)
                scores[p] = float(1 - own / others.min()) if len(others) else 1.0
            held.clear()
            places.clear()

        size = 0
        for p, text in enumerate(texts):
            k = self.symbols(spelled(text)) if text and self.table is not None else np.zeros(0, np.uint8)
            if k.any():
                held.append(k)
                places.append(p)
                size += len(k)
                if size > HELD:
                    tell()
                    size = 0
        tell()
        return names, scores, bits


def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    """One for each Python worker and set of samples."""
    return kept(lambda: Languages(dict(samples)), "languages", samples)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", only: Column | None = None) -> tuple[tuple[str, str], ...]:
    """(language, sample) of whole texts: rows in order of a hash, as long as they fit in what is learned of a language.

    A language none of whose whole texts fit is learned from slices, each from a text's first letter on.
    """
    lettered = F.col(text).rlike(r"\p{L}") & F.col(key).isNotNull() & F.col(lang).isNotNull()
    whole = (F.octet_length(text) <= LEARNED_EACH // 4).alias("_whole")
    rows = (docs if only is None else docs.where(only)).where(lettered).select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), whole)
    order = Window.partitionBy("_lang", "_whole").orderBy(F.xxhash64("_id"), "_id")
    few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(ROWS, SLICES)).where(F.col("_r") <= F.when(F.col("_whole"), ROWS).otherwise(SLICES))
    texts = docs.where(lettered).select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), whole, F.col(text).alias("_text"))
    part = F.when(F.col("_whole"), F.col("_text")).otherwise(F.regexp_extract("_text", rf"(?s)\p{{L}}.{{0,{LEARNED_EACH // SLICES - 1}}}", 0))
    got = texts.join(F.broadcast(few), ["_id", "_lang", "_whole"]).select("_lang", "_whole", "_r", part.alias("_text")).groupBy("_lang", "_whole", "_r").agg(F.min("_text").alias("_text")).collect()
    own: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r._lang, not r._whole, r._r)):
        own.setdefault(r._lang, []).append(r)
    each = max(LEAST_EACH, min(LEARNED_EACH, LEARNED // max(1, len(own))))
    out = []
    for name, texts_of in own.items():
        sample, room = [], each
        for r in texts_of:
            if r._whole and len(r._text) < room:
                sample.append(r._text)
                room -= len(r._text) + 1
        if not sample:
            for r in texts_of:
                first = next((i for i, c in enumerate(r._text) if c.isalpha()), 0)
                piece = r._text[first : first + max(0, room)]
                if piece:
                    sample.append(piece)
                    room -= len(piece) + 1
        out.append((name, "\n".join(sample)))
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all others than the text, if none are named) with lang_pred, score and bits for each character."""
    kinds = dict(docs.dtypes)
    names = keep if keep is not None else [c for c in docs.columns if c != text]
    told = docs.sparkSession.sparkContext.broadcast(samples)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = languages(told.value).identify(batch.column(len(names)).to_pylist())
        return pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())], names=[*names, "lang_pred", "score", "bits"])

    return map_arrow(docs.select(*names, F.col(text).alias("_text")), over, "".join(f"`{n}` {kinds[n]}, " for n in names) + "lang_pred string, score double, bits double", ROWS_HELD, BYTES_HELD)


def keep_identified(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, whole rows, whose language could be told; a null language becomes the one predicted."""
    place, filled = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None
    told = docs.sparkSession.sparkContext.broadcast(samples)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, _, _ = languages(told.value).identify(batch.column(place).to_pylist())
        found = pa.array(names, pa.string())
        if filled is not None:
            batch = batch.set_column(filled, lang, pc.coalesce(batch.column(filled), found))
        return batch.filter(pc.not_equal(found, NONE))

    return map_arrow(docs, over, docs.schema, ROWS_HELD, BYTES_HELD)
