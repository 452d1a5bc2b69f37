"""Temporal splits and ranking metrics, for all users, folds and arms in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.vectors import dot, unit
from quillon.operators import quantiles
from quillon.operators.ranking import average_rank


def catalogue_days(history: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(user, watched_at, n, flagged): whether a day holds more than the threshold of a user's history."""
    days = history.where("watched_at is not null").groupBy("user", "watched_at").agg(F.count("*").alias("n"))
    total = history.groupBy("user").agg(F.count("*").alias("_all"))
    return days.join(total, "user").select("user", "watched_at", "n", (F.col("n") > threshold * F.col("_all")).alias("flagged"))


def fold_cuts(history: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    """(user, fold, t_split, t_end): windows between the days at fractions of each user's dated history."""
    w = Window.partitionBy("user")
    placed = history.where("watched_at is not null").select("user", "watched_at", (F.row_number().over(w.orderBy("watched_at", "item")) - 1).alias("p"), (F.count("*").over(w) - 1).alias("last"))
    marks = F.array(*(F.struct(F.lit(k).alias("fold"), F.bround(F.lit(c) * F.col("last"), 0).cast("long").alias("at")) for k, c in enumerate(cuts)))
    hit = placed.select("user", "watched_at", "p", F.explode(marks).alias("m")).where("p = m.at").select("user", F.col("m.fold").alias("fold"), F.col("watched_at").alias("t_split"))
    ends = history.where("watched_at is not null").groupBy("user").agg(F.max("watched_at").alias("_end"))
    following = F.lead("t_split").over(w.orderBy("fold"))
    return hit.join(ends, "user").select("user", "fold", "t_split", F.coalesce(following, F.col("_end")).alias("t_end"))


def assignment(history: DataFrame, folds: DataFrame, flagged: DataFrame, corpus: DataFrame, inner: float = 0.8) -> DataFrame:
    """(user, fold, item, bucket, reason): inner, val, test or excluded for each row of the history and each fold.

    Joins each user's few folds to the rows of the user; the inner part is the first share of the training rows by date and id.
    """
    days = flagged.where("flagged").select("user", "watched_at", F.lit(True).alias("_flag"))
    known = corpus.select("item").distinct().withColumn("_in", F.lit(True))
    rows = history.join(days, ["user", "watched_at"], "left").join(known, "item", "left").join(folds, "user")
    late, early = F.col("watched_at") > F.col("t_end"), F.col("watched_at") <= F.col("t_split")
    reason = (
        F.when(F.col("watched_at").isNull(), "no_date").when(F.col("_flag"), "catalogue_day").when(early, None)
        .when(late, "after_window").when(F.col("rewatch"), "rewatch_dup").when(F.col("_in").isNull(), "not_in_corpus")
    )
    side = F.when(reason.isin("no_date", "catalogue_day"), "inner").when(early, "train").when(reason.isNotNull(), "excluded").otherwise("test")
    rows = rows.select("user", "fold", "item", "watched_at", side.alias("_side"), reason.alias("reason"))
    w = Window.partitionBy("user", "fold", "_side")
    place, size = F.row_number().over(w.orderBy("watched_at", "item")), F.count("*").over(w)
    cut = F.greatest(F.lit(1), F.bround(inner * size, 0))
    bucket = F.when(F.col("_side") == "train", F.when(place <= cut, "inner").otherwise("val")).otherwise(F.col("_side"))
    return rows.select("user", "fold", "item", bucket.alias("bucket"), "reason")


def relevance(half: Column) -> Column:
    return F.when(half >= 9, 3).when(half == 8, 2).when(half == 7, 1).otherwise(0)


def metrics(ranking: DataFrame, judged: DataFrame, k: int = 10, recall_k: int = 50, recall_rel: int = 2, asked: DataFrame | None = None) -> DataFrame:
    """(user, ndcg, recall, mrr) from rankings (user, item, rank) and judgements (user, item, rel); items not judged gain nothing.

    With `asked`, rows of a user and what tells its rankings apart, rankings hold these columns too and each row gets its metrics;
    what a user's judgements allow at best is found once.
    """
    keys = ["user"] if asked is None else asked.columns
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    ideal = judged.withColumn("_p", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("rel"), "item"))).groupBy("user")
    ideal = ideal.agg(F.sum(F.when(F.col("_p") <= k, gain / F.log2(F.col("_p") + 1.0))).alias("_ideal"), F.count_if(F.col("rel") >= recall_rel).alias("_wanted"))
    hits = ranking.where(F.col("rank") <= max(k, recall_k)).join(judged, ["user", "item"]).groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.count_if((F.col("rel") >= recall_rel) & (F.col("rank") <= recall_k)).alias("_hit"),
        F.min(F.when((F.col("rel") >= 1) & (F.col("rank") <= recall_k), F.col("rank"))).alias("_first"),
    )
    both = (ideal if asked is None else asked.join(ideal, "user")).join(hits, keys, "left")
    return both.select(
        *keys,
        F.when(F.col("_ideal") > 0, F.coalesce("_dcg", F.lit(0.0)) / F.col("_ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("_wanted") > 0, F.coalesce("_hit", F.lit(0)) / F.col("_wanted")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
    )


def spearman(rows: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """(groups, n, rho): correlation of average ranks; 0 where a side is constant or there are fewer than two rows."""
    r = rows.select(*groups, average_rank(F.col(x), groups, 1).alias("_a"), average_rank(F.col(y), groups, 1).alias("_b"))
    rho = F.when((F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0), F.covar_pop("_a", "_b") / (F.stddev_pop("_a") * F.stddev_pop("_b"))).otherwise(0.0)
    return r.groupBy(*groups).agg(F.count("*").alias("n"), rho.alias("rho"))


def list_distance(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user, distance): 1 - mean cosine of the pairs of a list (user, item); of unit vectors the sum gives all pairs at once."""
    own = lists.join(vectors, "item").select("user", unit(F.col("v")).alias("v"))
    sums = own.select("user", F.posexplode("v").alias("d", "x")).groupBy("user", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    total = sums.groupBy("user").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("pairs"), F.max("n").alias("n"))
    return total.select("user", F.when(F.col("n") > 1, 1 - F.col("pairs") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("distance"))


def novelty(lists: DataFrame, popularity: DataFrame) -> DataFrame:
    """(user, novelty): mean of log2 of the popularity rank over log2 of the corpus's size.

    Ranks come from exact counts of smaller values, and of smaller ids among equals, so no task holds the corpus.
    """
    above = quantiles.levels(popularity.select(F.lit(0).alias("_g"), (-F.col("popularity")).alias("value")), ["_g"]).select((-F.col("value")).alias("popularity"), F.col("below").alias("above"))
    within = quantiles.levels(popularity.select("popularity", F.col("item").alias("value")), ["popularity"], bins=16).select("popularity", F.col("value").alias("item"), "below")
    place = within.join(above, "popularity").select("item", (F.col("above") + F.col("below") + 1).alias("place"))
    size = popularity.agg(F.count("*").alias("n"))
    seen = lists.join(place, "item", "left").crossJoin(F.broadcast(size))
    return seen.groupBy("user").agg(F.avg(F.log2(F.coalesce("place", "n").cast("double")) / F.log2(F.col("n").cast("double"))).alias("novelty"))


def unknown_rate(lists: DataFrame, bridge: DataFrame, known: DataFrame) -> DataFrame:
    """(user, rate): share of a list whose people (item, person) the user (user, person) has never rated."""
    met = lists.join(bridge, "item").join(known, ["user", "person"], "left_semi").select("user", "item").distinct().withColumn("_known", F.lit(True))
    return lists.join(met, ["user", "item"], "left").groupBy("user").agg(F.avg(F.col("_known").isNull().cast("double")).alias("rate"))


def bootstrap_mean(values: DataFrame, groups: list[str], draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(groups, point, lo, hi, n): interval of the mean of `value` over draws of the rows (groups, id, value) with replacement.

    A draw weighs each row by a Poisson count made from a hash of the row and the draw, so all draws are sums that
    combine before the shuffle; the result depends on neither partitions nor order.
    """
    u = (F.pmod(F.xxhash64("id", "_draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0
    for count in range(1, 9):
        total += p
        p /= count
        weight = weight + (u > total).cast("int")
    each = values.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight)
    means = each.groupBy(*groups, "_draw").agg((F.sum(F.col("_w") * F.col("value")) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    ends = means.groupBy(*groups).agg(F.expr(f"percentile(m, array({alpha / 2}D, {1 - alpha / 2}D))").alias("e"))
    point = values.groupBy(*groups).agg(F.avg("value").alias("point"), F.count("*").alias("n"))
    return point.join(ends, groups).select(*groups, "point", F.element_at("e", 1).alias("lo"), F.element_at("e", 2).alias("hi"), "n")
