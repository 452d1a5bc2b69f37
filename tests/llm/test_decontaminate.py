import hashlib
import re

from quillon.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        n = min(10, len(i))
        for a in range(len(i) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == i[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "The Quick, brown fox; jumps over the lazy dog again and again!"), (2, "short item"), (3, None), (4, "..."), (5, "É a é"), (10, "short item"), (5, "a b")]
DOCS = [
    (1, "so the quick BROWN fox jumps over the lazy dog -- again and AGAIN it is a Short\nITEM", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (4, "shortest item short items", "x"),
    (5, "é A É b é a é", "x"),
    (6, "short item " * 4000, "x"),
    (6, "short item " * 4000, "x"),
    (7, "the quick brown fox jumps over the lazy dog", "x"),
    (None, "a b", "x"),
]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((i, *brute(t, ITEMS)) for i, t, _ in DOCS), key=str)
    found = dc.decontaminate(docs, items)
    assert rows(found) == want
    spans = {r.doc_id: r.hit_bytes for r in found.collect()}[1]
    text = DOCS[0][1].encode()
    assert [text[s.first : s.end] for s in spans] == [b"the quick BROWN fox jumps over the lazy dog -- again and AGAIN", b"Short\nITEM"]
    monkeypatch.setattr(dc, "SHARD_BYTES", 400)
    assert rows(dc.decontaminate(docs, items)) == want


def test_bytes_of_hits_in_several_shards(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")

    def places():
        return sorted(((r.doc_id, [tuple(s) for s in r.hit_bytes]) for r in dc.decontaminate(docs, items).collect()), key=str)

    one = places()
    assert sum(bool(s) for _, s in one) >= 4
    monkeypatch.setattr(dc, "SHARD_BYTES", 400)
    assert places() == one


def test_united_spans_keep_their_bytes():
    assert dc.covered([(4, 9, 40, 90), (0, 5, 0, 50), (1, 3, 10, 30), (12, 13, 120, 130)]) == [(0, 9, 0, 90), (12, 13, 120, 130)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.decontaminate(docs.limit(0), items).count() == 0
    assert not any(r[-1] for r in rows(dc.decontaminate(docs, items.limit(0))))
