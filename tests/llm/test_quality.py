import random

import numpy as np

from quillon.llm import quality as q


def text(rng, good):
    words = ["".join(rng.choice(["th", "er", "an", "in", "ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
    if not good:
        at = rng.randrange(len(words))
        words[at : at + 12] = [rng.choice([w + "###", w.upper() + "!!"]) for w in (words * 2)[at : at + 12]]
    return " ".join(words)


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, text(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(n)]


def test_gradients_match_differences():
    texts, labels = [b"hello world, this is a text!!", b"", bytes(range(1, 200))], np.array([1, 0, 1], np.float32)
    net = q.Network.fresh(3)
    for name in vars(net):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        p = net.score(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    grads = q.gradients(net, texts, labels)
    rng = np.random.default_rng(0)
    for x, g in zip(net.parts(), grads, strict=True):
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in x.shape)
            if x is net.vectors and at[0] == 0:
                continue
            old, step = x[at], 1e-6
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_held_out_accuracy(spark):
    data = rows(700, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    net = q.learn(docs, labels, only=F.col("doc_id") < 500)
    out = {r.doc_id: r.score for r in q.score(docs, net).collect()}
    assert sum((out[i] >= 0.3) == y for i, _, y in data[500:]) >= 190


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "x" * 3_000_000), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    net = q.learn(docs, labels)
    out = q.score(docs, net).collect()
    assert len(out) == 5 and all(abs(r.score - 0.5) < 1e-6 for r in out)
    assert q.score(docs.limit(0), net).count() == 0


def test_slices_do_not_change_scores(monkeypatch):
    net, t = q.Network.fresh(1), bytes(np.random.default_rng(0).integers(1, 255, 5000).astype(np.uint8))
    whole = net.score([t, b"ab", t[:777]])
    monkeypatch.setattr(q, "SLICE", 640)
    assert np.allclose(net.score([t, b"ab", t[:777]]), whole)
