import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quillon.llm import collocations as co


def plain(rows, least, most=2000, scale=2_000_000, inside=80):
    """The contract, in loops."""
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        held = {p: n for p, n in counts.items() if n >= least and len(p) > 1}
        found = []
        for p, a in held.items():
            if any(100 * n >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in held.items() if len(q) > len(p)):
                continue
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(rng, n):
    words = ["the", "The", "of", "a", "b", "c", "\x01x", "é", "日", "zz", "d"]
    rare = [f"rare{k}" for k in range(200)]
    rows = []
    for _ in range(n):
        t = "".join((rng.choice(words) if rng.random() < 0.85 else rng.choice(rare)) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 50)))
        rows.append((t, rng.choice(["en", "en", "en", "fr", None])))
    return [*rows, (None, "en"), ("", None), ("...", "xx"), ("new york city " * 400, "en"), ("only", "yy")]


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = [t for t, _ in corpus(rng, 50)] + [" ", "a", "É É", "a.b", "ÀB\x85c"]
    own = co.Words(pa.array(["cut off", *texts]).slice(1), ["x"] * len(texts))
    got = [(int(own.doc[k]), own.word(k), bool(own.follows[k])) for k in range(len(own))]
    want = []
    for d, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^ \t]+", piece)
            want += [(d, x, i + 1 < len(w)) for i, x in enumerate(w)]
    assert got == want
    assert len(co.Words(pa.array([None, ""], pa.string()), ["x", "y"])) == 0


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(co, "mixed", lambda h: h & co.np.uint64(1))
    own = co.Words(pa.array(["a b c d e a bb cc a dd b"]), ["x"])
    first, place = own.first_of(co.np.arange(len(own)))
    assert [own.word(first[k]) for k in place] == [own.word(k) for k in range(len(own))]


def test_automata_keep_counts():
    rng = random.Random(8)
    counts = [Counter({tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(rng.randint(0, 60))}) for _ in range(4)]
    made = [co.Transducer.unpack(co.Transducer.of(sorted(c.items())).pack()) for c in counts]
    assert [dict(m.items()) for m in made] == [dict(c) for c in counts]
    whole = co.united(made, least=5)
    summed = {p: n for p, n in sum(counts, Counter()).items() if n >= 5}
    assert dict(whole.items()) == summed and list(whole.items()) == sorted(summed.items())
    asked = sorted({tuple(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(300)})
    assert whole.compose(asked) == [summed.get(p, 0) for p in asked]
    big = co.Transducer.unpack(co.Transducer.of([(("a",), 1 << 40), (("a", "b"), 3)]).pack())
    assert dict(big.items()) == {("a",): 1 << 40, ("a", "b"): 3}
    tail = co.Transducer.of([((x, "same", "tail"), 2) for x in "abcdefgh"])
    assert len(tail.first) - 1 == 4  # what eight branches end with is kept once


@pytest.mark.parametrize("small", [False, True])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, small):
    rng = random.Random(12)
    rows = corpus(rng, 400)
    if small:  # many shards, ranges and shared buckets
        for name, value in (("SHARD", 300), ("RANGE", 20), ("WORD_BITS", 6), ("BITS", 6), ("SLICE", 16)):
            monkeypatch.setattr(co, name, value)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, phrase string").repartition(5)
    got = co.mine(docs, least=12, most=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 12, 40)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want
    if small:
        table, bounds = co.ngram_counts(docs, 12)
        assert len(bounds) > 3 and table.where("range >= 0").select("range").distinct().count() > 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert co.mine(none).collect() == []
    assert co.mine(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).collect() == []
