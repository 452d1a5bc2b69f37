"""Ranks, fusion and pool-relative scaling. Ties always break on the item's id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(hits: DataFrame, k: int, by: str = "score", groups: list[str] | None = None, item: str = "item") -> DataFrame:
    """The k best rows of each group with their rank from 1. Spark cuts each partition to k before it shuffles."""
    w = Window.partitionBy(*(groups or [])).orderBy(F.desc(by), item)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(hits: DataFrame, k: int, channel: str, by: str = "score", item: str = "item") -> DataFrame:
    """(channel, item, rank, score) of the k best of one list: a bounded sort, then ranks over k rows."""
    best = hits.select(F.col(item).alias("item"), F.col(by).cast("double").alias("score")).orderBy(F.desc("score"), "item").limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "item")
    return best.select(F.lit(channel).alias("channel"), "item", F.row_number().over(w).alias("rank"), "score")


def fused(channels: list[DataFrame], k: int = 60, weights: dict[str, float] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of w / (k + rank) over every hit, with the channels that found the item."""
    every = reduce(DataFrame.unionByName, channels)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(float(w))).otherwise(weight)
    return every.groupBy(*(groups or []), "item").agg(F.sum(weight / (k + F.col("rank"))).alias("rrf"), F.sort_array(F.collect_set("channel")).alias("channels"))


def unique_to_channel(pool: DataFrame) -> DataFrame:
    """(channel, n): items that one channel alone found."""
    return pool.where(F.size("channels") == 1).groupBy(F.element_at("channels", 1).alias("channel")).agg(F.count("*").alias("n"))


def average_rank(value: Column, groups: list[str], base: int = 0) -> Column:
    """The mean rank of equal values, ascending, from `base`."""
    below = F.rank().over(Window.partitionBy(*groups).orderBy(value.asc()))
    ties = F.count("*").over(Window.partitionBy(*groups, value))
    return below + (ties - 1) / 2.0 - 1 + base


def linear(scaled_values: DataFrame, beta: dict[str, float], bias: float = 0.0, feature: str = "feature") -> DataFrame:
    """(item, score): the sum of weight times scaled value; features without a weight count nothing."""
    w = F.lit(0.0)
    for name, b in beta.items():
        w = F.when(F.col(feature) == name, F.lit(float(b))).otherwise(w)
    return scaled_values.groupBy("item").agg((F.sum(w * F.col("scaled")) + bias).alias("score"))


def min_max(value: Column, groups: list[str]) -> Column:
    w = Window.partitionBy(*groups)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
