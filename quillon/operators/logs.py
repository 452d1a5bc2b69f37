"""Analytics over logs: validity of preferences, transcripts, streaks, costs and span trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import token_estimate


def validity(log: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """The log with valid_to: when the next row of the same key supersedes a row, or null."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    return log.withColumn("valid_to", F.lead(time).over(w))


def as_of(valid: DataFrame, time: str, at: Column) -> DataFrame:
    return valid.where((F.col(time) <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def within_budget(messages: DataFrame, session: str, seq: str, text: str, budget: int, overhead: int = 4) -> DataFrame:
    """The newest messages of each session whose token estimates fit in the budget; the newest one always."""
    cost = token_estimate(F.coalesce(F.col(text), F.lit(""))) + overhead
    w = Window.partitionBy(session).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = messages.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w)).withColumn("_last", F.max(seq).over(Window.partitionBy(session)))
    return sums.where((F.col("used") <= budget) | (F.col(seq) == F.col("_last"))).drop("_last")


def streaks(log: DataFrame, keys: list[str], order: list[str], bad: Column) -> DataFrame:
    """(keys, longest): the longest run of bad rows in order, 0 where there is none (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.sum((~bad).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = log.withColumn("_bad", bad).withColumn("_island", island).groupBy(*keys, "_island").agg(F.sum(F.col("_bad").cast("int")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def latest(rates: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rates.columns if c not in (*keys, time)]
    best = rates.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("b"))
    return best.select(*keys, *(F.col("b")[c].alias(c) for c in (time, *rest)))


def rated(calls: DataFrame, rates: DataFrame, on: str, rate: str) -> DataFrame:
    """The calls with the rate of their own value, or that of `*`."""
    own = rates.select(F.col(on).alias("_on"), F.col(rate).alias("_own"))
    any_ = rates.where(F.col(on) == "*").agg(F.max(rate).alias("_any"))
    joined = calls.join(F.broadcast(own), F.col(on) == F.col("_on"), "left").crossJoin(F.broadcast(any_))
    return joined.withColumn(rate, F.coalesce("_own", "_any")).drop("_on", "_own", "_any")


def depths(tree: DataFrame, node: str, parent: str, most_steps: int = 40) -> DataFrame:
    """(node, depth) of each node below a root, by pointer doubling: a tree of depth d takes log2(d) joins."""
    jumps = tree.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("d"))
    for _ in range(most_steps):
        over = jumps.select(F.col("n").alias("m"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        jumps = jumps.join(over, F.col("up") == F.col("m"), "left").select("n", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")).checkpoint()
        if jumps.where("up is not null").isEmpty():
            return jumps.select(F.col("n").alias(node), F.col("d").alias("depth"))
    raise ValueError("the tree has a cycle or is deeper than 2 to the number of steps")
