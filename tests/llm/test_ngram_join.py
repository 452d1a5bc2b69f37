import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import ngram_join as nj

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    own = [sets(t) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])] for i in range(n)]
    label = [i for i, _ in rows]
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in link[i])]) for i in range(n)]
    return sorted((i, len(s), c) for (i, _), s, c in zip(rows, own, label, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu")
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 80]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(25):  # one passage in many documents, some of them little else
        own = [word() for _ in range(rng.choice([2, 6, 10, 40]))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    chain = [word() for _ in range(60)]
    for k in range(0, 24, 3):
        texts.append(" ".join(chain[k : k + 30]))
    texts += ["", " \t\n", "one", "One", "ONE two", "one  TWO\n", "a b c d", "a b c d e", "É x", "é x", texts[3], texts[3].upper(), "x " * 9000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\n\t", max_size=30)), min_size=1, max_size=6))
def test_hashes_stand_for_shingles(texts):
    got = [s for _, some in nj.slices(pa.array(texts, pa.string())) for s in some]
    known = {}
    for text, hashes in zip(texts, got, strict=True):
        w = words(text)
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(want) == len(hashes)
        for a, b in zip(want, hashes.tolist(), strict=True):
            assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    frequent = np.sort(rng.choice(1000, 200, replace=False).astype(np.uint64))
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.choice(1000, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.7, 1)))), rng.choice(1000, int(rng.integers(0, 8))).astype(np.uint64)]))
        met = len(np.intersect1d(a, b))
        if 100 * met >= 75 * (len(a) + len(b) - met):
            need = min(3, -(-75 * min(len(a), len(b)) // 100))
            assert len(np.intersect1d(nj.prefix(a, frequent, 75, 3), nj.prefix(b, frequent, 75, 3))) >= need


def test_against_brute_force(spark):
    for seed, frequent in ((1, 50), (2, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string").repartition(3)
        assert sorted(map(tuple, nj.join(docs, frequent=frequent).collect())) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark, monkeypatch):
    rows = [(5, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (7, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(docs).collect())) == [(4, 3, 4), (4, 3, 4), (5, 0, 5), (7, 3, 4)]
    assert sorted(map(tuple, nj.keep_first(docs.withColumn("_h", F.lit(1)).withColumn("num", F.lit("x"))).collect())) == [(4, "a b c d e f g", 1, "x"), (5, None, 1, "x")]
    assert nj.join(docs.limit(0)).count() == 0 and nj.keep_first(docs.limit(0)).count() == 0
    rows = corpus(3)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nj, "LARGE", 1)
    monkeypatch.setattr(nj, "SIDE", 60)
    monkeypatch.setattr(nj, "HELD", 100)
    monkeypatch.setattr(nj, "ONCE", 3)
    assert sorted(map(tuple, nj.join(docs, frequent=2).collect())) == brute(rows)


def test_null_keys_link(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs away from all the other dogs in the yard of the house"
    rows = [(None, base), (9, base + " today"), (None, base), (None, "one two three four five six"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(docs).collect()), key=str)
    first = {base: 9, rows[1][1]: 9}
    assert got == sorted(((i, len(sets(t)), first.get(t)) for i, t in rows), key=str)
    assert len(sets(base)) == 20  # 24 words
    assert sorted(map(tuple, nj.keep_first(docs).collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
