"""Table maintenance as pure functions: each takes the old rows and the new ones and returns the table that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, of the largest version; of equal versions the new row. Rows are combined before the shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *(c for c in rest if c != version))).alias("b"))
    return best.select(*(c if c in keys else F.col("b")[c].alias(c) for c in old.columns))


def frozen_first(old: DataFrame, new: DataFrame, keys: list[str], frozen: list[str]) -> DataFrame:
    """New rows replace old ones, but frozen columns keep their first value that isn't null."""
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = c if on is None else on & c
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in frozen or c in keys else F.when(F.col(f"n.{keys[0]}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, on, "full").select(*(pick(c).alias(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones of keys that aren't there."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """The children of the parents named are the new ones alone; all others stay."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.join(parents.select(parent).distinct(), parent, "left_semi").select(*old.columns))


def with_stubs(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The dimension with an empty row for each key that only the facts know."""
    absent = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    return dimension.unionByName(absent, allowMissingColumns=True)


def changed(documents: DataFrame, stored: DataFrame, keys: list[str], digest: str = "sha") -> DataFrame:
    """The documents that aren't stored or whose digest differs, null-safe."""
    held = stored.select(*keys, F.col(digest).alias("_held"), F.lit(True).alias("_there"))
    return documents.join(held, keys, "left").where(F.col("_there").isNull() | ~F.col(digest).eqNullSafe(F.col("_held"))).drop("_held", "_there")


def pruned(stored: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return stored.join(targets.select(key).distinct(), key, "left_semi")


def retained(parents: DataFrame, children: DataFrame, key: str, time: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows not older than the cutoff, and the children of these."""
    kept = parents.where(F.col(time) >= cutoff)
    return kept, children.join(kept.select(key), key, "left_semi")
