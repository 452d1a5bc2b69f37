import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import language as lg

SAMPLES = {"aa": "the cat sat on the mat and the other cat ran", "bb": "der hund lief und die katze saß auf der matte", "cc": "x"}
TABLES = lg.Languages(SAMPLES)


def brute(text, sample, tables=TABLES):
    """Greedy longest matches by substring search."""
    read, known, count, i = tables.symbols(lg.spelled(text)).tobytes(), tables.symbols(lg.spelled(sample)).tobytes(), 0, 0
    while i < len(read):
        j = i
        while j < len(read) and read[i : j + 1] in known:
            j += 1
        i, count = max(j, i + 1), count + 1
    return count


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdefhimnorstuß THEé1日 ", max_size=60), min_size=1, max_size=5))
def test_phrases_against_brute_force(texts):
    got = TABLES.phrases([TABLES.symbols(lg.spelled(t)) for t in texts])
    assert got.tolist() == [[brute(t, SAMPLES[n]) for t in texts] for n in TABLES.names]


def test_blocks_are_only_a_way_to_walk():
    rng = random.Random(2)
    texts = ["the other cat sat " * 700, "a" * 30_000, "at" * 9_000 + "the mat", "".join(rng.choice("thecatsonmru ") for _ in range(20_000)), "x" * 2048, "x" * 2049, "der hund " * 3000]
    own = TABLES.phrases([TABLES.symbols(lg.spelled(t)) for t in texts])
    assert own.tolist() == [[brute(t, SAMPLES[n]) for t in texts] for n in TABLES.names]
    runs = {"aa": "a" * 700 + "b", "bb": "ab" * 300}
    tables = lg.Languages(runs)  # long matches: guesses stay wrong for many blocks
    assert tables.phrases([tables.symbols(lg.spelled(t)) for t in texts]).tolist() == [[brute(t, runs[n], tables) for t in texts] for n in tables.names]


def test_every_letter_has_a_spelling_of_its_own():
    rng = random.Random(4)
    scripts = [range(0x3B1, 0x3CA), range(0x430, 0x450), range(0x4E00, 0x4E00 + 900), range(0x61, 0x7B)]
    samples = {f"l{k}": "".join(chr(rng.choice(s)) + rng.choice(["", "", " "]) for _ in range(2000)) for k, s in enumerate(scripts)}
    tables = lg.Languages(samples)
    seen = sorted({c for s in samples.values() for c in s if c.isalpha()})
    assert len(seen) > 900 and len({tables.symbols(lg.spelled(c)).tobytes() for c in seen}) == len(seen)
    for name, sample in samples.items():
        told = tables.identify([sample[300:500], sample[7:8]])[0]
        assert told[0] == name
    texts = ["".join(rng.choice("".join(seen) + "ツж é") for _ in range(200)) for _ in range(5)]
    assert tables.phrases([tables.symbols(lg.spelled(t)) for t in texts]).tolist() == [[brute(t, samples[n], tables) for t in texts] for n in tables.names]


def test_no_labelled_language_is_lost(spark):
    rng = random.Random(5)

    def prose(lang, n):
        parts = ["".join(rng.choice(lang) for _ in range(3)) for _ in range(12)]
        return lambda: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))

    def table(made):
        return spark.createDataFrame([(100 * k + i, t, lang) for k, (lang, texts) in enumerate(made) for i, t in enumerate(texts)], "doc_id long, text string, lang string")

    # a language of long texts only, one of which begins with many characters that are no letters
    short, books = prose("abcdef", 40), prose("ghijkl", 4000)
    docs = table([("aa", [short() for _ in range(9)]), ("bb", ["1 " * 20_000 + books(), books(), books()]), ("cc", ["12 34"])])
    samples = dict(lg.learn(docs))
    assert sorted(samples) == ["aa", "bb"] and 10_000 < len(samples["bb"]) <= lg.LEARNED_EACH
    assert {(r.lang, r.lang_pred) for r in lg.identify(docs, tuple(samples.items())).collect()} == {("aa", "aa"), ("bb", "bb"), ("cc", "und")}

    # thirty languages of texts longer than the room that each has
    letters = "abcdefghijklmnopqrstuvwxyz"
    thirty = [(f"l{k:02}", [make() for _ in range(3)]) for k in range(30) for make in [prose(rng.sample(letters, 6), 1000)]]
    docs = table(thirty)
    samples = lg.learn(docs)
    assert [n for n, _ in samples] == [n for n, _ in thirty] and all(len(t) <= lg.LEARNED // 30 for _, t in samples)
    assert all(r.lang == r.lang_pred for r in lg.identify(docs, samples).collect())


def test_rows_and_held_out_accuracy(spark):
    rng = random.Random(3)
    parts = {"aa": ["th", "er", "an", "ing", "ou"], "bb": ["sch", "ei", "ung", "er", "ich"], "cc": ["ção", "os", "el", "ar", "que"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60)), lang, "x"))
    odd = [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "123 !?", None, "x"), (903, "thering", None, "x"), (903, "thering", None, "x"), (904, "schei " * 50_000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F

    samples = lg.learn(docs, only=F.col("doc_id") % 2 == 0)
    assert [n for n, _ in samples] == ["aa", "bb", "cc"]
    out = lg.identify(docs, samples, keep=["doc_id"]).collect()
    told = {r.doc_id: r for r in out}
    assert len(out) == 306 and all(0 <= r.score <= 1 for r in out)
    assert all(told[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [told[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"]
    assert lg.identify(docs.limit(0), samples, keep=["doc_id"]).count() == 0
    nothing = lg.learn(docs.limit(0))
    assert {r.lang_pred for r in lg.identify(docs, nothing, keep=["doc_id"]).collect()} == {"und"}
