"""Taste statistics for all users at once: signals, tiers and shrunken affinities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.storage import small

#: Prior weights by kind of entity, and ratings that a kind needs.
KAPPA = {"director": 2.0, "writer": 3.0, "actor": 4.0, "keyword": 6.0, "genre": 8.0, "language": 4.0, "country": 5.0, "decade": 6.0, "runtime": 6.0, "collection": 2.0}
LEAST = {"keyword": 2, "actor": 2}
SUPPORT = 12


def signals(history: DataFrame, floor: float = 0.35) -> DataFrame:
    """The history with z, each rating's distance from its user's mean in standard deviations of at least `floor` stars, and its mass."""
    stars = F.col("rating_half") / 2.0
    by_user = history.groupBy("user").agg(F.avg(stars).alias("_mean"), F.greatest(F.stddev_pop(stars), F.lit(floor)).alias("_std"))
    z = (stars - F.col("_mean")) / F.col("_std")
    return history.join(by_user, "user").withColumn("z", z).withColumn("mass", F.least(F.abs("z"), F.lit(3.0))).drop("_mean", "_std")


def tier(n: Column) -> Column:
    return F.when(n < 30, "cold").when(n < 150, "thin").otherwise("full")


def exposure(n: Column, watched: Column, corpus_n: Column, corpus_total: Column, kappa: Column) -> Column:
    """Log odds of watching an entity against its share of the corpus, shrunk toward it."""
    near = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), p))
    base = F.least(F.greatest(corpus_n.cast("double"), F.lit(0.5)) / corpus_total, F.lit(1.0 - 1e-6))
    mine = near((n + kappa * base) / (watched + kappa))
    return F.log(mine / (1 - mine)) - F.log(base / (1 - base))


def affinities(rated: DataFrame, entities: DataFrame, support: bool | Column = True, among: DataFrame | None = None) -> DataFrame:
    """(user, kind, entity, n, affinity, exposure, support) from signals (user, item, z) and a bridge (kind, entity, item).

    One job for all users and kinds: the bridge is joined once, sums and counts are combined before the shuffle, and
    only the twelve strongest items of an entity are kept as its support. Without `support` that column is left out, and with
    it the sort of all joined rows; a condition says which entities have any. `among`: (user, kind, entity) that are asked for, each once.
    """
    kappa = F.create_map(*(x for k, v in KAPPA.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    least = F.coalesce(F.create_map(*(x for k, v in LEAST.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")], F.lit(1))
    corpus = entities.groupBy("kind", "entity").agg(F.count_distinct("item").alias("corpus_n"))
    total = entities.agg(F.count_distinct("item").alias("corpus_total"))
    watched = rated.groupBy("user").agg(F.count_distinct("item").alias("watched"))
    both = rated.select("user", "item", "z").join(entities, "item")
    if among is not None:
        both = both.join(F.broadcast(among) if small(among, 100) else among, ["user", "kind", "entity"], "left_semi")
    sums = both.groupBy("user", "kind", "entity").agg(F.count("*").alias("n"), F.sum("z").alias("raw")).where(F.col("n") >= least)
    out = sums.join(watched, "user").join(corpus, ["kind", "entity"]).crossJoin(F.broadcast(total))
    told = ["user", "kind", "entity", "n", (F.col("raw") / (F.col("n") + kappa)).alias("affinity"), exposure(F.col("n"), F.col("watched"), F.col("corpus_n"), F.col("corpus_total"), kappa).alias("exposure")]
    if support is False:
        return out.select(*told)
    both = both if support is True else both.where(support)
    strongest = both.withColumn("_r", F.row_number().over(Window.partitionBy("user", "kind", "entity").orderBy(F.desc(F.round(F.abs("z"), 9)), "item"))).where(F.col("_r") <= SUPPORT)
    items = strongest.groupBy("user", "kind", "entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "item"))), lambda s: s["item"]).alias("support"))
    return out.join(items, ["user", "kind", "entity"], "left").select(*told, "support")


def vote_quality(rated: DataFrame, prior: float = 200.0) -> DataFrame:
    """(item, votes, mean, quality): each item's mean pulled to the mean of all items by so many votes."""
    by_item = rated.groupBy("item").agg(F.count("*").alias("votes"), F.avg(F.col("rating_half") / 2.0).alias("mean"))
    pool = by_item.agg(F.avg("mean").alias("_pool"))
    w = F.col("votes") / (F.col("votes") + prior)
    return by_item.crossJoin(F.broadcast(pool)).select("item", "votes", "mean", (w * F.col("mean") + (1 - w) * F.col("_pool")).alias("quality"))
