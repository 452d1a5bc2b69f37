"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, and leading articles of titles.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
ARTICLES = "the|a|an|le|la|les|un|une|der|die|das|el|los|las|il|lo"


def normal_title(title: Column) -> Column:
    """Lower case, without marks, punctuation and a leading article; null stays null."""
    folded = F.translate(F.lower(title), MARKED, PLAIN)
    words = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, rf"^({ARTICLES}) (?=.)", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def terms(text: Column) -> Column:
    """Lower-cased words of letters and digits, without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def hook(text: Column, limit: int = 180) -> Column:
    """The first sentence, cut at a word's end where it is longer than the limit; of a blank text nothing, of a null one null."""
    return fit(F.coalesce(F.get(sentences(text), 0), F.when(text.isNotNull(), "")), limit)


def fit(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut back to a word's end."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*\z", "")  # $ would also match before a last line break
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def flat(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def leaks(text: Column, title: Column) -> Column:
    """Whether a text names a title, as whole words."""
    inside = F.concat(F.lit(" "), normal_title(text), F.lit(" "))
    needle = normal_title(title)
    return (needle != "") & F.contains(inside, F.concat(F.lit(" "), needle, F.lit(" ")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
