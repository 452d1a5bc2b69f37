import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import alignment as al
from quillon.llm.token_counts import byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
BYTE = {letter: k for k, letter in byte_letters().items()}


def plain(text):
    """The groups (ids of A, ids of B) of one text, from whole encodings and a walk over all bytes; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [B.id_to_piece(i)]]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in v]).tolist() for v in (a_bytes, b_bytes))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def told(groups):
    if groups is None:
        return ""
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


ODD = ["a  b", "  a", " ", "   ", "a\nb", "\nb", "b\n", "\n", "a\tb ", "a\r\nb;\r\n c", "x;\r", "a▁b", "\x00a", "é", "e\u0301x", "a \n  b ", "<s> hi </s> <|endoftext|><0x0A>", "!\x1c?", "a\x85b\xa0 c\u3000d\u2028e", "日本語 テキスト", "\U0001f600\U0001f601 x", "\ufeffx", "it's WE'RE 12345 3.14", "x" * 300, "  \n\n  \t z", "ﬁ \u200b\u180e q", "\u0130 ß"]


def texts(rng, n):
    words = ["the", "Thing", "naïve", "über", "x1", "...", "(a)", "日本", "foo_bar", "e\u0301", "don't", "http://a.b/c?d=e"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t", ", ", "-", "\n\n ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_merge_path_gives_common_ends():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.int64) for _ in range(2))
        want = [(a.tolist().index(e) + 1, b.tolist().index(e) + 1) for e in sorted(set(a.tolist()) & set(b.tolist()))]
        for work in (1, 2, 3, 7, 4096):
            x, y = al.merged(a, b, work)
            assert list(zip(x.tolist(), y.tolist(), strict=True)) == want
        at = np.arange(len(a) + len(b) + 1)
        merge = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
        assert al.diagonal(a, b, at).tolist() == [sum(s == 0 for _, s in merge[:k]) for k in at]


def test_units_give_what_whole_texts_give(monkeypatch):
    monkeypatch.setattr(al, "WORK", 5)
    rng = random.Random(4)
    own, many = al.Aligner(A_PATH, B_PATH), ODD + texts(rng, 300) + ["a" + c + "b" + c + c + "!" + c for c in map(chr, range(1, 0x250))]
    assert own.divided
    for t, (units, ok) in zip(many, own.align(many), strict=True):
        want = plain(t)
        assert ok == (want is not None), repr(t)
        if ok:
            assert b";".join(u.groups for u in units).decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want), repr(t)


@pytest.mark.parametrize("block", [1, 24 << 20])
def test_corpus_counts(spark, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    rng = random.Random(6)
    rows = [(k, t) for k, t in enumerate([None, "", *ODD, *texts(rng, 40), "long text " * 9000])] + [(3, "a  b"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_best int").repartition(3)
    groups = [(k, plain(t)) for k, t in rows]
    count = Counter((x[-1], y[-1]) for _, g in groups for x, y in g or [])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for k, g in groups:
        links = [(x[-1], y[-1]) for x, y in g or []]
        want.append((k, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), told(g)))
    got = al.align(docs, A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []
