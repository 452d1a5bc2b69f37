"""Summaries of fits, pages and pools, and words taken out of or found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import quantiles

#: The shortest word that is taken out of a text, and words that stay.
LEAST_LETTERS = 3
STAYING = ("the", "and", "for", "from", "with", "that", "this", "her", "his", "you", "les", "der", "una")
#: What counts as a year, a running time and a number of stars.
YEAR = r"\b(1[89]\d{2}|20[0-3]\d)\b"
MINUTES = r"(?i)\b(\d{2,3})\s*(?:minutes|minute|mins|min)\b"
STARS = r"(?i)\b([0-5](?:\.5)?)\s*(?:stars|star)\b"


def stability(fits: DataFrame) -> DataFrame:
    """(feature, mean, sd, middle, agree, active) of weights (fold, feature, weight), one row for each; a fold without a feature counts as 0.

    agree: folds whose weight has the median's sign; active: folds whose weight isn't 0. A feature's weights are one
    array no longer than the number of folds, so no grid of folds and features is made.
    """
    folds = fits.agg(F.count_distinct("fold").cast("int").alias("_n"))
    some = fits.groupBy("feature").agg(F.collect_list("weight").alias("_w")).crossJoin(F.broadcast(folds))
    w = some.withColumn("_w", F.array_sort(F.concat("_w", F.array_repeat(F.lit(0.0), F.col("_n") - F.size("_w")))))
    at = lambda k: F.element_at("_w", k.cast("int"))
    w = w.withColumn("middle", (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2)
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda a, x: a + f(x))
    w = w.withColumn("mean", total(lambda x: x) / F.col("_n"))
    return w.select(
        "feature",
        "mean",
        F.sqrt(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / F.col("_n")).alias("sd"),
        "middle",
        F.size(F.filter("_w", lambda x: F.signum(x) == F.signum("middle"))).alias("agree"),
        F.size(F.filter("_w", lambda x: x != 0)).alias("active"),
    )


def ratio_to_median(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """The rows with `ratio`: the value over its group's median, 1 where that is 0."""
    middle = quantiles.medians(rows, groups, value, "_m")
    return rows.join(middle, groups).withColumn("ratio", F.when(F.col("_m") != 0, F.col(value) / F.col("_m")).otherwise(1.0)).drop("_m")


def page_means(rows: DataFrame, group: str, order: list[Column], value: str, size: int) -> DataFrame:
    """(group, page, n, mean): the mean of a value on each page of a group's ordered rows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(place / size)).groupBy(group, "page").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def ends(rows: DataFrame, groups: list[str], value: str, name: str, k: int) -> DataFrame:
    """The k rows of the highest and of the lowest value of each group, with `side` (best or worst) and `place`; ties by name."""
    out = []
    for side, order in (("best", F.desc(value)), ("worst", F.asc(value))):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(order, name))
        out.append(rows.withColumn("place", place).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


def naming_words(text: Column) -> Column:
    """The distinct words of a name that give it away, in order of the alphabet."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(*STAYING))))


def without(text: Column, words: Column) -> Column:
    """The text without the words, whatever their case, and with single spaces; words are of letters and digits only, of any script."""
    pattern = F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(words, "|"), F.lit(r")\b"))
    left = F.when(F.size(words) > 0, F.regexp_replace(text, pattern, F.lit(" "))).otherwise(text)
    return F.trim(F.regexp_replace(left, r"\s+", " "))


def found(text: Column, pattern: str) -> Column:
    """The first group of each match of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
