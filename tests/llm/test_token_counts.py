import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.Counter(PATH)


def told(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab c'\n\tsré日😀<|>09")), st.characters(exclude_categories=["Cs"])), max_size=40), st.integers(0, 40))
def test_any_prefix_counts_as_the_library_counts_it(text, cut):
    cut = min(cut, len(text))
    assert COUNTER.total(text) == told(text)
    assert tc.Prefixes(text, COUNTER).at(cut) == told(text[:cut])


def test_special_strings_and_long_words():
    for text in ["<|endoftext|>", "a<|endoftext|>b<|endo", "x" * 5000, " " * 999 + "a", ""]:
        assert COUNTER.total(text) == told(text)
        for cut in range(0, len(text), max(1, len(text) // 9)):
            assert tc.Prefixes(text, COUNTER).at(cut) == told(text[:cut])


def test_fit_keeps_within_the_budget():
    text = "The quick brown foxes jumped unbelievably over 12345 lazy dogs. " * 20
    kept = tc.Prefixes(text, COUNTER).fit(57)
    assert told(text[:kept]) <= 57 < told(text[: kept + 12])


def longest(text, budget):
    return max(c for c in range(len(text) + 1) if told(text[:c]) <= budget)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab c're\n\tsréд日😀<|>09  ")), st.characters(exclude_categories=["Cs"])), max_size=40), st.integers(0, 30))
def test_fit_finds_the_longest_prefix_of_the_library(text, budget):
    assert tc.Prefixes(text, COUNTER).fit(budget) == longest(text, budget)


def test_fit_around_special_strings_and_white_space():
    for text in ["ab <|endoftext|> cd", "a   \nword", "a \n\n  don't're", "x" * 70 + "   <|endoftext|>"]:
        for budget in range(told(text) + 1):
            assert tc.Prefixes(text, COUNTER).fit(budget) == longest(text, budget)


def test_fit_in_long_runs_of_one_character():
    for mark, budget in ((" ", 9), ("-", 5), ("=", 7), ("x", 11)):
        text = "some words " + mark * 20_000 + " end"
        kept = tc.Prefixes(text, COUNTER).fit(budget)
        assert told(text[:kept]) <= budget
        assert all(told(text[:c]) > budget for c in range(kept + 1, min(kept + 600, len(text))))
        assert all(told(text[:c]) > budget for c in range(kept + 600, len(text), 997))


def test_prefix_counts_of_words_are_kept():
    counter = tc.Counter(PATH)
    counter.total("unbelievable")
    assert list(counter.words.held["unbelievable"]) == [told("unbelievable"[:n]) for n in range(13)]


def test_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "it's <|endoftext|> é", "x"), (4, "word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(map(tuple, tc.token_counts(docs, PATH, 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    assert out == sorted((i, len((t or "").encode()), told(t or ""), told(t or "") > 1024) for i, t, _ in rows)
    assert tc.token_counts(docs.limit(0), PATH).count() == 0
    stored = {r.doc_id: r for r in tc.prefix_counts(docs, PATH).collect()}
    assert stored[4].counts[-1] == told("word " * 3000) and stored[4].ends[-1] == 15000 and stored[2].ends == []
