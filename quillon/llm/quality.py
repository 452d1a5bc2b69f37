"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become short learned vectors. Learned filters of WIDTH bytes slide over the text in steps of two; each keeps its
largest value in every block of BLOCK bytes, and a chunk is two neighbouring blocks, so chunks overlap by half and
cover the whole document. A hidden layer looks at each chunk's maxima, the largest value of each hidden unit over all
chunks is the document's vector, and a logistic unit makes one probability of it.

The network is fitted on at most `ROWS` labelled rows of at most `ROW_BYTES` bytes, picked in order of a hash;
every document is scored whole.

Defined results: null and empty texts are scored as one block of padding; repeated rows give one row each; rows
with a null or other label are not learned from; without rows of both labels the share of label 1 among them is
the score of every text (0.5 without any); very long texts are read in bounded slices; further columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow

#: Labelled rows that are learned from at most, and the largest of them in bytes.
ROWS, ROW_BYTES = 2400, 6000
VECTOR, WIDTH, FILTERS, BLOCK, HIDDEN = 4, 8, 24, 64, 32
EPOCHS, BATCH, RATE = 14, 48, 0.01
#: Bytes of text that are scored at once.
SLICE = 1 << 20


@dataclass
class Network:
    """The weights: byte vectors, filters, hidden layer, output."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        vectors = rng.normal(size=(256, VECTOR)).astype(np.float32)
        vectors[0] = 0
        return cls(vectors, draw(WIDTH * VECTOR, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, 1)[:, 0], np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def convolve(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte vectors two by two, with room behind; filter values at every second byte) of padded bytes."""
        pairs = np.zeros((len(data) // 2 + WIDTH // 2 - 1, 2 * VECTOR), self.vectors.dtype)
        pairs[: len(data) // 2] = self.vectors[data].reshape(-1, 2 * VECTOR)
        n, step = len(data) // 2, 2 * VECTOR
        value = pairs[:n] @ self.filters[:step]
        for k in range(1, WIDTH // 2):
            value += pairs[k : k + n] @ self.filters[k * step : (k + 1) * step]
        value += self.bias
        return pairs, np.maximum(value, 0, out=value)

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each block."""
        return np.concatenate([self.convolve(data[k : k + SLICE + BLOCK])[1].reshape(-1, BLOCK // 2, FILTERS).max(axis=1)[: SLICE // BLOCK] for k in range(0, len(data), SLICE)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, firsts = padded(texts)
        chunk = chunks(self.maxima(data), firsts)
        top = np.maximum.reduceat(np.maximum(chunk @ self.hidden + self.hidden_bias, 0), firsts)
        return 1 / (1 + np.exp(-(top @ self.out + self.out_bias[0]).astype(np.float64)))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' bytes, each followed by zeros to whole blocks, at least one filter's width; the first block of each)."""
    sizes = [-(-(len(t) + WIDTH) // BLOCK) for t in texts]
    data = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, sizes, strict=True))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def chunks(maxima: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The maxima over each block and the one behind it in the same text."""
    after = np.roll(maxima, -1, axis=0)
    last = np.append(firsts[1:], len(maxima)) - 1
    after[last] = maxima[last]
    return np.maximum(maxima, after)


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, by each part of the network."""
    data, firsts = padded(texts)
    pairs, value = net.convolve(data)
    blocks = value.reshape(-1, BLOCK // 2, FILTERS)
    where = blocks.argmax(axis=1)
    maxima = np.take_along_axis(blocks, where[:, None, :], axis=1)[:, 0]
    n = len(maxima)
    last = np.append(firsts[1:], n) - 1
    following = np.arange(n) + 1
    following[last] = last
    own = maxima >= maxima[following]
    chunk = np.where(own, maxima, maxima[following])
    hidden = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
    top = np.maximum.reduceat(hidden, firsts)
    p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias[0])))

    d = ((p - labels) / len(labels)).astype(np.float32)
    d_top = d[:, None] * net.out
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(firsts, n)))
    best = (hidden == top[text]) & (hidden > 0)
    d_hidden = best * d_top[text] / np.maximum(1, np.add.reduceat(best, firsts))[text]
    d_chunk = d_hidden @ net.hidden.T
    d_max = np.where(own, d_chunk, 0)
    np.add.at(d_max, following, np.where(own, 0, d_chunk))
    d_max *= maxima > 0

    block, filt = np.nonzero(d_max)
    g = d_max[block, filt].astype(np.float32)
    place = block * (BLOCK // 2) + where[block, filt]
    seen = pairs[place[:, None] + np.arange(WIDTH // 2)].reshape(len(place), WIDTH * VECTOR)
    d_filters = np.zeros_like(net.filters)
    for f in range(FILTERS):
        mine = filt == f
        d_filters[:, f] = g[mine] @ seen[mine]
    back = (g[:, None] * net.filters.T[filt]).reshape(len(place) * WIDTH, VECTOR)
    at = (2 * place[:, None] + np.arange(WIDTH)).ravel()
    byte = np.append(data, np.zeros(WIDTH, np.uint8))[at]
    d_vectors = np.stack([np.bincount(byte, back[:, k], 256) for k in range(VECTOR)], axis=1).astype(np.float32)
    d_vectors[0] = 0
    d_bias = np.bincount(filt, g, FILTERS).astype(np.float32)
    return [d_vectors, d_filters, d_bias, chunk.T @ d_hidden, d_hidden.sum(axis=0), top.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: list[int], seed: int = 5) -> Network:
    """A network fitted by Adam; deterministic for the same rows in the same order."""
    y = np.array(labels, np.float32)
    net = Network.fresh(seed)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.out[:] = 0
        net.out_bias[0] = np.log(share / (1 - share))
        return net
    net.out_bias[0] = np.log(y.mean() / (1 - y.mean()))
    first, second = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            pick = order[k : k + BATCH]
            step += 1
            rate = RATE * min(1.0, (EPOCHS - epoch) / (EPOCHS / 2))
            for x, g, m, v in zip(net.parts(), gradients(net, [texts[i] for i in pick], y[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", only: Column | None = None, seed: int = 5) -> Network:
    """Fit on a bounded sample of the labelled rows for which `only`, a column of the key, holds."""
    ids = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").dropDuplicates(["_id"])
    if only is not None:
        ids = ids.withColumnRenamed("_id", key).where(only).withColumnRenamed(key, "_id")
    sizes = docs.select(F.col(key).alias("_id"), F.octet_length(F.coalesce(text, F.lit(""))).alias("_n")).where(F.col("_n") <= ROW_BYTES)
    few = ids.join(sizes, "_id", "left_semi").orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(ROWS)
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).where(F.octet_length("_text") <= ROW_BYTES).join(F.broadcast(few), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    got = sorted((r._id, r._text, r._label) for r in rows.collect())
    return fit([t.encode("utf-8", "surrogatepass") for _, t, _ in got], [y for *_, y in got], seed)


def score(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The key, and other columns to keep, with each document's score."""
    kinds = dict(docs.dtypes)
    names = [key, *(keep or [])]
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pickle.loads(held.value)
        out, some, size = [], [], 0
        for value in batch.column(len(names)).to_pylist():
            some.append((value or "").encode("utf-8", "surrogatepass"))
            size += len(some[-1])
            if size > SLICE:
                out.append(own.score(some))
                some, size = [], 0
        if some:
            out.append(own.score(some))
        return pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(np.concatenate(out), pa.float64())], names=[*names, "score"])

    return map_arrow(docs.select(*names, text), over, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score double")
