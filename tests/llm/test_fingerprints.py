import hashlib
import random

import pytest

from quillon.llm import fingerprints as fp


def text(rng, n, letters="abcdefghé 日\U0001f600"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_spans_and_extensions_are_those_of_the_texts():
    rng = random.Random(3)
    for _ in range(60):
        a, b = text(rng, rng.randint(0, 80), "ab"), text(rng, rng.randint(0, 80), "ab")
        ha, hb = fp.PrefixHashes(a), fp.PrefixHashes(b)
        for _ in range(40):
            i, j, n = rng.randint(0, len(a)), rng.randint(0, len(b)), rng.randint(0, 12)
            assert ha.equal(i, hb, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
            most = 0
            while i + most < len(a) and j + most < len(b) and a[i + most] == b[j + most]:
                most += 1
            assert ha.extension(i, hb, j) == most
    assert not fp.PrefixHashes("ab").equal(-1, fp.PrefixHashes("ab"), 0, 1)


def test_equal_texts_alone_have_equal_fingerprints(monkeypatch):
    rng = random.Random(5)
    texts = list({text(rng, n, letters) for n in (*range(40), 300, 2000) for letters in ("ab", "abcdefgh ", "日é")})
    told = {t: fp.fingerprint(t) for t in texts}
    assert len(set(told.values())) == len(texts) and fp.fingerprint(None) == fp.fingerprint("")
    monkeypatch.setattr(fp, "BLOCK", 64)  # blocks don't change a fingerprint
    assert {t: fp.fingerprint(t) for t in texts} == told
    assert max(map(len, told.values())) < 1100


def test_likeness_follows_what_is_shared():
    rng = random.Random(9)
    for n in (5, 9, 40, 300, 5000, 60000):
        a, b = text(rng, n), "#" + text(rng, n)[1:]
        whole, edited, other = (fp.fingerprint(x) for x in (a, a[: n - n // 3] + b[: n // 3], b))
        assert fp.likeness(whole, whole) == 1
        assert 0.4 < fp.likeness(whole, edited) < 1 and fp.likeness(whole, edited) == pytest.approx(fp.likeness(edited, whole), abs=0.35)
        assert fp.likeness(whole, other) < 0.3
        if n > 100:
            moved, middle = fp.fingerprint("new words before it " + a), fp.fingerprint(a[: n // 2] + "changed" + a[n // 2 :])
            assert fp.likeness(whole, moved) > 0.7 and fp.likeness(whole, middle) > 0.7
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0 and fp.likeness(fp.fingerprint("a" * 9000), fp.fingerprint("a" * 6000 + text(rng, 3000))) > 0.4


ROWS = [(7, "seven " * 30), (5, "five"), (5, "five"), (3, None), (2, ""), (1, "x" * 5000), (None, "no id at all, and longer than the rest"), (11, "é日" * 9), (5, "other five")]




@pytest.mark.parametrize("size", [1, 3, 2048])
def test_edits_take_the_next_document(spark, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE", size)
    rows = [r for r in ROWS if r != (5, "other five")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = fp.with_edits(docs).collect()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    want = []
    for (k, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y, z = map(fp.fingerprint, (a, edited, b))
        want.append((k, len(a), hashlib.sha256(edited.encode()).hexdigest(), x, y, fp.likeness(x, y), fp.likeness(x, z)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_of_one_id_are_spread_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE", 8)
    docs = spark.createDataFrame([(1 if i % 3 else i, f"text {i} " * 9) for i in range(300)], "doc_id long, text string").repartition(4)
    placed = fp.ranges(docs, "text", "doc_id")
    hot = placed.where("_k = 1 and not guest").groupBy("bucket").count().collect()
    assert len(hot) > 5 and fp.with_edits(docs).count() == 300
    one = spark.createDataFrame([(4, "alone in its table")], "doc_id int, text string")
    assert [r.near_next for r in fp.with_edits(one).collect()] == [1.0]
    assert fp.with_edits(one.limit(0)).collect() == [] and fp.fingerprints(one).columns == ["doc_id", "n_chars", "fingerprint"]
    assert fp.fingerprints(one).first().fingerprint == fp.fingerprint("alone in its table")
