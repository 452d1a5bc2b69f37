"""Names that are close to what was asked, none lost: shared pairs of characters filter, edit distance decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import similarity


def grams(name: Column) -> Column:
    """The pairs of neighbouring characters of a name with its ends marked, each numbered by how often it stood before."""
    marked = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substr(marked, i, F.lit(2)))
    # the n-th of equal pairs is a gram of its own: sorted, each counts those before it that are the same
    ordered = F.array_sort(pairs)
    return F.transform(ordered, lambda g, i: F.concat(g, (i - F.array_position(ordered, g).cast("int") + 1).cast("string")))


def close(asked: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(asked, name, similarity) of all pairs of distinct strings with 1 - distance / longer length of `least` or more.

    A string of n characters has n + 1 marked pairs, and one edit touches two of them. Strings that close share at least
    (2 * least - 1) * n + 1 of the longer one's, so it's enough to compare those that share one of their rarest pairs: as many as
    leave fewer than that. `least` must be over one half. Defined results: null strings are close to nothing, two empty
    ones are equal; repeated strings count once.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must lie over one half")
    a = asked.select(F.col("asked").alias("s")).where("s is not null").distinct()
    b = names.select(F.col("name").alias("s")).where("s is not null").distinct()
    of = lambda rows: rows.select("s", F.explode(grams(F.col("s"))).alias("g"))
    common = of(b).groupBy("g").agg(F.count("*").alias("_n"))

    def rare(rows: DataFrame) -> DataFrame:
        """The rarest pairs of each string, as many as a close one can't miss all of."""
        each = of(rows).join(common, "g", "left").groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "g"))).alias("gs"))
        shared = F.ceil((2 * least - 1) * F.length("s") - 1e-9) + 1
        return each.select("s", F.explode(F.slice("gs", 1, F.greatest(F.lit(1), F.size("gs") - shared + 1).cast("int"))).alias("e")).select("s", "e.g")

    left, right = rare(a).withColumnRenamed("s", "asked"), rare(b).withColumnRenamed("s", "name")
    size = lambda c: F.length(c)
    pairs = left.join(right, "g").where(F.least(size("asked"), size("name")) >= least * F.greatest(size("asked"), size("name")) - 1e-9).select("asked", "name").distinct()
    told = pairs.withColumn("similarity", F.when((size("asked") == 0) & (size("name") == 0), 1.0).otherwise(similarity(F.col("asked"), F.col("name"))))
    return told.where(F.col("similarity") >= least - 1e-9)


def suggestions(asked: DataFrame, names: DataFrame, n: int = 3, least: float = 0.6) -> DataFrame:
    """(asked, name, similarity, place): the n closest names to each string, ties by name."""
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(F.round("similarity", 9)), "name"))
    return close(asked, names, least).withColumn("place", place).where(F.col("place") <= n)
