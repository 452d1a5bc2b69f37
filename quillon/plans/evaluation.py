"""Queries: temporal splits, ranking metrics, baselines, user signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import affinity as A
from quillon.operators import evaluation as E
from quillon.operators import knn, quantiles, ranking
from quillon.operators import splits as S
from quillon.plans import adapter as T
from quillon.plans.registry import query
from quillon.plans.retrieval import CENTROIDS
from quillon.session import table

CUTS = (0.5, 0.7, 0.85)
#: Items of a head that are broadcast, at most; beyond it they are shuffled.
BROADCAST = 100_000


@query("ag9_user_history", T.SQL + " SELECT user, item, CAST(watched_at AS VARCHAR) AS watched_at, rating_half, rewatch FROM custhist")
def user_history(spark, sf):
    return T.history(spark, sf, "customer").withColumn("watched_at", F.col("watched_at").cast("string"))


@query("ag10_rating_histogram", T.SQL + " SELECT user, rating_half, count(*) AS n FROM hist GROUP BY ALL")
def histogram(spark, sf):
    return T.history(spark, sf).groupBy("user", "rating_half").agg(F.count("*").alias("n"))


@query("tm2_signals", T.SQL + " SELECT user, item, round(z, 6) AS z, round(least(abs(z), 3), 6) AS mass FROM (SELECT user, item, (rating_half / 2.0 - m) / s AS z FROM custhist JOIN (SELECT user, avg(rating_half / 2.0) AS m, greatest(stddev_pop(rating_half / 2.0), 0.35) AS s FROM custhist GROUP BY 1) USING (user))")
def signals(spark, sf):
    return A.signals(T.history(spark, sf, "customer")).select("user", "item", F.round("z", 6).alias("z"), F.round("mass", 6).alias("mass"))


@query("tm3_tiers", T.SQL + " SELECT user, n, CASE WHEN n < 30 THEN 'cold' WHEN n < 150 THEN 'thin' ELSE 'full' END AS tier FROM (SELECT user, count(*) AS n FROM custhist GROUP BY 1)")
def tiers(spark, sf):
    return T.history(spark, sf, "customer").groupBy("user").agg(F.count("*").alias("n")).withColumn("tier", A.tier(F.col("n")))


@query("ev1_catalogue_days", T.SQL + " SELECT user, CAST(watched_at AS VARCHAR) AS watched_at, n, n > 0.02 * a AS flagged FROM (SELECT user, watched_at, count(*) AS n FROM custhist GROUP BY ALL) JOIN (SELECT user, count(*) AS a FROM custhist GROUP BY 1) USING (user)")
def catalogue_days(spark, sf):
    return E.catalogue_days(T.history(spark, sf, "customer")).withColumn("watched_at", F.col("watched_at").cast("string"))


SPLIT = """, days AS (SELECT user, watched_at FROM (SELECT user, watched_at, count(*) AS n FROM hist GROUP BY ALL) JOIN (SELECT user, count(*) AS a FROM hist GROUP BY 1) USING (user) WHERE n > 0.02 * a
), rel AS (SELECT * FROM hist ANTI JOIN days USING (user, watched_at)
), placed AS (SELECT user, watched_at, row_number() OVER (PARTITION BY user ORDER BY watched_at, item) - 1 AS p, count(*) OVER (PARTITION BY user) - 1 AS last FROM rel
), marks AS (SELECT user, fold, watched_at AS t_split FROM placed, (VALUES (0, 0.5), (1, 0.7), (2, 0.85)) c(fold, cut) WHERE p = CAST(round_even(CAST(cut AS DOUBLE) * last, 0) AS BIGINT)
), folds AS (SELECT user, fold, t_split, coalesce(lead(t_split) OVER (PARTITION BY user ORDER BY fold), e) AS t_end FROM marks JOIN (SELECT user, max(watched_at) AS e FROM rel GROUP BY 1) USING (user)
), sides AS (
  SELECT user, fold, item, watched_at, CASE WHEN flag THEN 'catalogue_day' WHEN watched_at <= t_split THEN NULL WHEN watched_at > t_end THEN 'after_window' WHEN rewatch THEN 'rewatch_dup' WHEN item NOT IN (SELECT item FROM items WHERE runtime >= 3) THEN 'not_in_corpus' END AS reason,
    CASE WHEN flag THEN 'inner' WHEN watched_at <= t_split THEN 'train' WHEN watched_at > t_end OR rewatch OR item NOT IN (SELECT item FROM items WHERE runtime >= 3) THEN 'excluded' ELSE 'test' END AS side FROM hist JOIN folds USING (user) LEFT JOIN (SELECT user, watched_at, true AS flag FROM days) USING (user, watched_at)
), assigned AS (
  SELECT user, fold, item, CASE WHEN side = 'train' THEN CASE WHEN row_number() OVER w <= greatest(1, round_even(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY user, fold, side), 0)) THEN 'inner' ELSE 'val' END ELSE side END AS bucket, reason
  FROM sides WINDOW w AS (PARTITION BY user, fold, side ORDER BY watched_at, item)
)"""


def reliable(history: DataFrame) -> DataFrame:
    """Rows off every catalogue day."""
    return history.join(E.catalogue_days(history).where("flagged").select("user", "watched_at"), ["user", "watched_at"], "left_anti")


@query("ev3_fold_windows", T.SQL + SPLIT + " SELECT user, fold, CAST(t_split AS VARCHAR) AS t_split, CAST(t_end AS VARCHAR) AS t_end FROM folds")
def folds(spark, sf):
    return E.fold_cuts(reliable(T.history(spark, sf)), CUTS).select("user", "fold", F.col("t_split").cast("string").alias("t_split"), F.col("t_end").cast("string").alias("t_end"))


def assigned(spark, sf, h: DataFrame | None = None) -> DataFrame:
    h = T.history(spark, sf) if h is None else h
    return E.assignment(h, E.fold_cuts(reliable(h), CUTS), E.catalogue_days(h), T.items(spark, sf).where("runtime >= 3"))


@query("ev4_fold_assignment", T.SQL + SPLIT + " SELECT user, fold, item, bucket, reason FROM assigned")
def assignment(spark, sf):
    return assigned(spark, sf)


@query("st5_overlap_guard", T.SQL + SPLIT + " SELECT fold, count(*) AS n FROM (SELECT user, fold, item FROM assigned WHERE bucket IN ('inner', 'val') INTERSECT SELECT user, fold, item FROM assigned WHERE bucket = 'test') GROUP BY 1")
def overlap(spark, sf):
    a = assigned(spark, sf)
    return a.where("bucket in ('inner', 'val')").select("user", "fold", "item").intersect(a.where("bucket = 'test'").select("user", "fold", "item")).groupBy("fold").agg(F.count("*").alias("n"))


@query("ag27_coverage", T.SQL + " SELECT r_name AS region, count(*) AS n, round(avg(CASE WHEN runtime >= 10 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM hist JOIN items USING (item) JOIN nation ON user = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT rewatch GROUP BY 1")
def coverage(spark, sf):
    regions = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("user"), F.col("r_name").alias("region"))
    rows = T.history(spark, sf).where("not rewatch").join(T.items(spark, sf), "item").join(regions, "user")
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg((F.col("runtime") >= 10).cast("double")), 6).alias("covered"))


#: Rankings of fold 1: each user's unseen items by popularity, 50 of them; judged by what the fold tests.
ARMS = SPLIT + """, judged AS (
  SELECT a.user, a.item, CASE WHEN rating_half >= 9 THEN 3 WHEN rating_half = 8 THEN 2 WHEN rating_half = 7 THEN 1 ELSE 0 END AS rel, rating_half FROM assigned a JOIN hist USING (user, item) WHERE fold = 1 AND bucket = 'test'
), train AS (SELECT user, item FROM assigned WHERE fold = 1 AND bucket IN ('inner', 'val')
), ranked AS (
  SELECT user, item, popularity, row_number() OVER (PARTITION BY user ORDER BY popularity DESC, item) AS rank FROM (SELECT DISTINCT user FROM judged), items WHERE (user, item) NOT IN (SELECT (user, item) FROM train) QUALIFY rank <= 50
)"""


def judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    a, h = assigned(spark, sf).where("fold = 1"), T.history(spark, sf)
    test = a.where("bucket = 'test'").join(h, ["user", "item"]).select("user", "item", E.relevance(F.col("rating_half")).alias("rel"), "rating_half")
    return test, a.where("bucket in ('inner', 'val')").select("user", "item")


def popular(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranking, judgements, training rows). No list is longer than 50, so 50 + the most items that a user has seen are enough of the popular ones."""
    test, train = judged(spark, sf)
    return unseen(T.items(spark, sf).select("item", "popularity"), test, train), test, train


def unseen(items: DataFrame, test: DataFrame, train: DataFrame, n: int = 50) -> DataFrame:
    """Each test user's first n items (item, popularity) that are not among the training rows.

    A user who has seen h of a head of the items finds them among its first n + h places, if it has so many: the head grows
    until it has for everyone, or holds all items. Its items are numbered once, and each user asks for so many places.
    """
    reach, total = 2 * n, items.count()
    while True:
        best = items.orderBy(F.desc("popularity"), "item").limit(reach)
        met = train.select("user", "item").join(F.broadcast(best.select("item")) if reach <= BROADCAST else best.select("item"), "item").distinct()
        held = met.groupBy("user").agg(F.count("*").alias("_h"))
        if reach >= total or n + (held.agg(F.max("_h")).first()[0] or 0) <= reach:
            break
        reach *= 4
    placed = best.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("popularity"), "item")))
    asked = test.select("user").distinct().join(held, "user", "left").select("user", F.explode(F.sequence(F.lit(1), (n + F.coalesce("_h", F.lit(0))).cast("int"))).alias("_place"))
    pairs = asked.join(placed, "_place").drop("_place").join(met, ["user", "item"], "left_anti")
    return ranking.ranked(pairs, n, "popularity", ["user"])


@query("ev21_baseline_popularity", T.SQL + ARMS + " SELECT user, item, rank FROM ranked")
def baseline(spark, sf):
    return popular(spark, sf)[0].select("user", "item", F.col("rank").cast("long").alias("rank"))


METRICS = """, ideal AS (SELECT user, sum(CASE WHEN p <= 10 THEN (pow(2, rel) - 1) / log2(p + 1) END) AS i, count(*) FILTER (rel >= 2) AS w FROM (SELECT user, rel, row_number() OVER (PARTITION BY user ORDER BY rel DESC, item) AS p FROM judged) GROUP BY 1
), got AS (SELECT user, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS d, count(*) FILTER (rel >= 2) AS h, min(rank) FILTER (rel >= 1) AS f FROM ranked JOIN judged USING (user, item) GROUP BY 1
), metric AS (SELECT user, CASE WHEN i > 0 THEN coalesce(d, 0) / i ELSE 0 END AS ndcg, CASE WHEN w > 0 THEN coalesce(h, 0) / w ELSE 0 END AS recall, coalesce(1.0 / f, 0) AS mrr FROM ideal LEFT JOIN got USING (user))"""


@query("ev8_ndcg_recall_mrr", T.SQL + ARMS + METRICS + " SELECT user, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM metric")
def metrics(spark, sf):
    r, test, _ = popular(spark, sf)
    return E.metrics(r, test).select("user", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))


@query("ev12_spearman", T.SQL + ARMS + """ SELECT user, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END, 6) AS rho FROM (
  SELECT user, rank() OVER (PARTITION BY user ORDER BY popularity) + (count(*) OVER (PARTITION BY user, popularity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY user ORDER BY rating_half) + (count(*) OVER (PARTITION BY user, rating_half) - 1) / 2.0 AS b FROM judged JOIN items USING (item)) GROUP BY 1""")
def spearman(spark, sf):
    rows = judged(spark, sf)[0].join(T.items(spark, sf).select("item", "popularity"), "item")
    return E.spearman(rows, "popularity", "rating_half", ["user"]).select("user", "n", F.round("rho", 6).alias("rho"))


@query("ev13_intra_list_distance", T.SQL + ARMS + ", l AS (SELECT user, item, v FROM judged JOIN vectors USING (item)) SELECT user, round(CASE WHEN avg(s) IS NULL THEN 0 ELSE 1 - avg(s) END, 6) AS distance FROM (SELECT DISTINCT user FROM l) LEFT JOIN (SELECT a.user, list_cosine_similarity(a.v, b.v) AS s FROM l a JOIN l b ON a.user = b.user AND a.item < b.item) USING (user) GROUP BY 1")
def list_distance(spark, sf):
    out = E.list_distance(judged(spark, sf)[0].select("user", "item"), T.vectors(spark, sf).select("item", "v"))
    return out.select("user", F.round("distance", 6).alias("distance"))


@query("ev15_novelty", T.SQL + ARMS + " SELECT user, round(avg(log2(place) / log2(n)), 6) AS novelty FROM judged JOIN (SELECT item, row_number() OVER (ORDER BY popularity DESC, item) AS place FROM items) USING (item), (SELECT count(*) AS n FROM items) GROUP BY 1")
def novelty(spark, sf):
    return E.novelty(judged(spark, sf)[0].select("user", "item"), T.items(spark, sf).select("item", "popularity")).select("user", F.round("novelty", 6).alias("novelty"))


@query("ev16_unknown_director_rate", T.SQL + ARMS + ", known AS (SELECT DISTINCT user, person FROM train JOIN credits USING (item) WHERE role = 'director') SELECT user, round(avg(CASE WHEN EXISTS (SELECT 1 FROM credits c JOIN known k USING (person) WHERE c.role = 'director' AND c.item = r.item AND k.user = r.user) THEN 0.0 ELSE 1.0 END), 6) AS rate FROM ranked r GROUP BY 1")
def unknown(spark, sf):
    r, _, train = popular(spark, sf)
    directors = T.credits(spark, sf).where("role = 'director'").select("item", "person")
    known = train.join(directors, "item").select("user", "person").distinct()
    return E.unknown_rate(r.select("user", "item"), directors, known).select("user", F.round("rate", 6).alias("rate"))


@query("ev14_mode_coverage", T.SQL + ARMS + CENTROIDS + " SELECT user, round(count(DISTINCT mode) / least(10, count(*)), 6) AS coverage FROM judged JOIN (SELECT item, arg_max(mode, (c, -mode)) AS mode FROM (SELECT item, mode, list_cosine_similarity(v, q) AS c FROM vectors, cent) GROUP BY 1) USING (item) GROUP BY 1")
def mode_coverage(spark, sf):
    from quillon.plans.retrieval import modes

    own = judged(spark, sf)[0].join(knn.assigned(T.vectors(spark, sf), modes(spark, sf)), "item")
    return own.groupBy("user").agg(F.round(F.count_distinct("mode") / F.least(F.lit(10), F.count("*")), 6).alias("coverage"))


@query("ev21_baseline_director_affinity", T.SQL + SPLIT + """, t AS (SELECT a.user, a.item, rating_half / 2.0 AS stars FROM assigned a JOIN hist USING (user, item) WHERE fold = 1 AND bucket IN ('inner', 'val')), d AS (
  SELECT user, person, (sum(stars - m)) / (count(*) + 2.0) AS aff FROM t JOIN (SELECT user, avg(stars) AS m FROM t GROUP BY 1) USING (user) JOIN credits USING (item) WHERE role = 'director' GROUP BY ALL HAVING count(*) >= 2)
  SELECT user, item, round(score, 6) AS score, rank FROM (SELECT user, item, score, row_number() OVER (PARTITION BY user ORDER BY score DESC, popularity DESC, item) AS rank FROM (
    SELECT user, item, round(max(aff), 9) AS score FROM d JOIN credits USING (person) WHERE role = 'director' GROUP BY ALL) JOIN items USING (item) WHERE (user, item) NOT IN (SELECT (user, item) FROM t)) WHERE rank <= 10""")
def director_affinity(spark, sf):
    directors = T.credits(spark, sf).where("role = 'director'").select("item", "person")
    t = assigned(spark, sf).where("fold = 1 and bucket in ('inner', 'val')").join(T.history(spark, sf), ["user", "item"]).select("user", "item", (F.col("rating_half") / 2.0).alias("stars"))
    mean = t.groupBy("user").agg(F.avg("stars").alias("m"))
    aff = t.join(mean, "user").join(directors, "item").groupBy("user", "person").agg((F.sum(F.col("stars") - F.col("m")) / (F.count("*") + 2.0)).alias("aff"), F.count("*").alias("n")).where("n >= 2")
    score = aff.join(directors, "person").groupBy("user", "item").agg(F.round(F.max("aff"), 9).alias("score")).join(t, ["user", "item"], "left_anti").join(T.items(spark, sf).select("item", "popularity"), "item")
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), F.desc("popularity"), "item"))
    return score.withColumn("rank", rank).where("rank <= 10").select("user", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ev21_baseline_single_centroid", T.SQL + SPLIT + """, liked AS (SELECT a.user, a.item FROM assigned a JOIN hist USING (user, item) WHERE fold = 1 AND bucket IN ('inner', 'val') AND rating_half >= 8), c AS (
  SELECT user, list(s ORDER BY d) AS q FROM (SELECT user, d, sum(x) AS s FROM (SELECT user, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM liked JOIN vectors USING (item)) GROUP BY ALL) GROUP BY 1)
  SELECT user, item, round(score, 6) AS score, rank FROM (SELECT user, item, score, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (SELECT user, item, round(list_cosine_similarity(v, q), 9) AS score FROM c, vectors)) WHERE rank <= 10""")
def single_centroid(spark, sf):
    liked = assigned(spark, sf).where("fold = 1 and bucket in ('inner', 'val')").join(T.history(spark, sf), ["user", "item"]).where("rating_half >= 8").select("user", "item", F.lit(1.0).alias("w"))
    v = T.vectors(spark, sf).select("item", "v")
    q = knn.centroid(v, liked, ["user"])
    # users stand as queries, in blocks; a few more than ten, as equal scores count to nine digits
    scores = knn.nearest(v, q.select(F.col("user").alias("query"), "q"), 20).select(F.col("query").alias("user"), "item", F.round("score", 9).alias("score"))
    return ranking.ranked(scores, 10, groups=["user"]).select("user", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ev19_mean_interval")
def bootstrap(spark, sf):
    """The interval of the mean over users of what popularity gets."""
    r, test, _ = popular(spark, sf)
    values = E.metrics(r, test).select(F.lit("popularity").alias("arm"), F.col("user").alias("id"), F.col("ndcg").alias("value"))
    return E.bootstrap_mean(values, ["arm"])


@query("ev18_bootstrap_interval")
def intervals(spark, sf):
    """Each user's interval of NDCG over draws of the judged items."""
    r, test, _ = popular(spark, sf)
    return S.intervals(test, r)


@query("ev20_paired_bootstrap")
def paired(spark, sf):
    """Each user's interval of the difference between the popular and the cheap items, and how often the popular ones win; both see the same draws."""
    r, test, train = popular(spark, sf)
    other = unseen(T.items(spark, sf).select("item", (-F.col("popularity")).alias("popularity")), test, train)
    return S.intervals(test, r, other)


@query("wn2_average_ranks", T.SQL + " SELECT item, round(rank() OVER (PARTITION BY genre ORDER BY runtime) - 1 + (count(*) OVER (PARTITION BY genre, runtime) - 1) / 2.0, 6) AS rank FROM items")
def average_ranks(spark, sf):
    """Each item's mean rank by running time among those of its genre."""
    i = T.items(spark, sf).select("item", "genre", F.col("runtime").alias("value"))
    return i.join(quantiles.levels(i, ["genre"]), ["genre", "value"]).select("item", F.round(quantiles.average_rank(), 6).alias("rank"))
