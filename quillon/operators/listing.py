"""Listings and comparisons: pages, lookbacks, recent rows, shared attributes, proximity and weights of matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Years within which a year is still near, what an unknown year counts, and the votes of full weight.
NEAR_YEARS, UNKNOWN_YEAR, FULL_VOTES = 4.0, 0.5, 200_000


def page(rows: DataFrame, order: Column, limit: int, offset: int = 0, item: str = "item") -> DataFrame:
    """The rows at places offset + 1 to offset + limit, with `place`. Each partition is cut to the head before places are told."""
    head = rows.orderBy(order, item).limit(offset + limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, item))
    return head.withColumn("place", place).where(F.col("place") > offset)


def contains(text: Column, needle: str) -> Column:
    """Whether the text holds the needle, whatever the case; % and _ are plain characters."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def having_all(rows: DataFrame, clauses: list[DataFrame], item: str = "item") -> DataFrame:
    """The rows whose item each clause has."""
    return reduce(lambda df, c: df.join(c.select(item), item, "left_semi"), clauses, rows)


def lookback(events: DataFrame, time: str, spans: dict[str, str], groups: list[str]) -> DataFrame:
    """Of each group the number of events within each span before the newest of all."""
    now = events.agg(F.max(time).alias("_now"))
    counts = [F.count_if(F.col(time) >= F.col("_now") - F.expr(f"interval {span}")).alias(name) for name, span in spans.items()]
    return events.crossJoin(F.broadcast(now)).groupBy(*groups).agg(*counts)


def before(rows: DataFrame, time: str, cut: str | None) -> DataFrame:
    """Rows strictly before a day; without one all, also those without a date."""
    return rows if cut is None else rows.where(F.col(time) < F.lit(cut).cast("date"))


def most_recent(rows: DataFrame, n: int, groups: list[str], time: str, item: str) -> DataFrame:
    """The newest n rows of each group."""
    order = Window.partitionBy(*groups).orderBy(F.desc(time), item)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def compared(attributes: DataFrame, pairs: DataFrame, names: list[str], item: str = "item") -> DataFrame:
    """The pairs (left_item, right_item) of items that have attributes (arrays), with shared_* and all_* of each."""
    side = lambda s: attributes.select(F.col(item).alias(f"{s}_item"), *(F.col(n).alias(f"_{s}_{n}") for n in names))
    both = pairs.join(side("left"), "left_item").join(side("right"), "right_item")
    shared = [F.array_sort(F.array_intersect(f"_left_{n}", f"_right_{n}")).alias(f"shared_{n}") for n in names]
    either = [F.array_sort(F.array_union(f"_left_{n}", f"_right_{n}")).alias(f"all_{n}") for n in names]
    return both.select("left_item", "right_item", *shared, *either)


def year_drift(years: Column, year: Column) -> Column:
    """The distance from a year to the nearest of several; null where none is known."""
    return F.array_min(F.transform(years, lambda y: F.abs(y - year)))


def year_proximity(drift: Column) -> Column:
    return F.when(drift.isNull(), UNKNOWN_YEAR).otherwise(F.greatest(F.lit(0.0), 1 - drift / NEAR_YEARS))


def vote_weight(votes: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.coalesce(votes, F.lit(0))) / F.log1p(F.lit(FULL_VOTES)))


def band(value: Column, low: float, high: float, floor: float, ceiling: float) -> Column:
    """A value between low and high mapped to floor and ceiling, clamped; a null one counts as low."""
    value = F.coalesce(value, F.lit(float(low)))
    return floor + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))) * (ceiling - floor)


def borda(position: Column, n: Column) -> Column:
    """Points of a place from 0 among n: 1 for the first, 0 for the last."""
    return F.when(n > 1, (n - 1 - position) / (n - 1)).otherwise(1.0)


def windows(sizes: DataFrame, n: str, size: int, stride: int) -> DataFrame:
    """(..., first, stop) of windows of positions that overlap; the last one ends at n. One window where n is no more than size."""
    last = F.greatest(F.col(n) - size, F.lit(0))
    firsts = F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))
    return sizes.withColumn("first", F.explode(firsts)).withColumn("stop", F.least(F.col("first") + size, F.col(n)))


def preferred_first(items: DataFrame, wanted: DataFrame, bucket: str, k: int) -> DataFrame:
    """(bucket, item, rank): for each bucket wanted its k first items, those of the bucket by popularity, then all others by popularity.

    No bucket's list needs more than the k most popular items of its own and the k most popular of all.
    """
    w = Window.partitionBy(bucket).orderBy(F.desc("popularity"), "item")
    own = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(bucket, "item", "popularity", F.lit(0).alias("_other")).join(wanted, bucket, "left_semi")
    best = items.orderBy(F.desc("popularity"), "item").limit(2 * k).select(F.col(bucket).alias("_b"), "item", "popularity")
    rest = wanted.crossJoin(F.broadcast(best)).where(F.col(bucket) != F.col("_b")).select(bucket, "item", "popularity", F.lit(1).alias("_other"))
    # the k most popular of all others: of the head, what is of the bucket itself stands in its own list
    every = own.unionByName(rest)
    order = Window.partitionBy(bucket).orderBy("_other", F.desc("popularity"), "item")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(bucket, "item", "rank")
