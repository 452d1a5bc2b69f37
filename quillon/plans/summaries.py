"""Queries: summaries of fits, pages and pools, baselines and words of texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import affinity as A
from quillon.operators import summaries as S
from quillon.plans import adapter as T
from quillon.plans.evaluation import ARMS, judged, unseen
from quillon.plans.registry import query
from quillon.plans.retrieval import ENTITIES, entities
from quillon.session import table


@query("sr8_best_and_worst_entities", T.SQL + ENTITIES + """, a AS (SELECT user, kind, entity, round(raw / (n + kappa), 9) AS affinity FROM aff)
  SELECT user, kind, entity, round(affinity, 6) AS affinity, side, place FROM (
    SELECT *, 'best' AS side, row_number() OVER (PARTITION BY user, kind ORDER BY affinity DESC, entity) AS place FROM a UNION ALL
    SELECT *, 'worst', row_number() OVER (PARTITION BY user, kind ORDER BY affinity, entity) FROM a) WHERE place <= 8""")
def best_and_worst(spark, sf):
    own = A.affinities(A.signals(T.history(spark, sf)), entities(spark, sf), support=False).select("user", "kind", "entity", F.round("affinity", 9).alias("affinity"))
    return S.ends(own, ["user", "kind"], "affinity", "entity", 8).select("user", "kind", "entity", F.round("affinity", 6).alias("affinity"), "side", F.col("place").cast("long").alias("place"))


@query("ev21_baseline_random", T.SQL + ARMS + """, shuffled AS (SELECT item, md5('0-' || item) AS o FROM items)
  SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY o DESC, item) AS rank FROM (SELECT DISTINCT user FROM judged), shuffled WHERE (user, item) NOT IN (SELECT (user, item) FROM train) QUALIFY rank <= 50""")
def random_baseline(spark, sf):
    """One seeded order of all items by a hash; each user gets its first fifty that are new to them."""
    test, train = judged(spark, sf)
    order = T.items(spark, sf).select("item", F.md5(F.concat(F.lit("0-"), F.col("item").cast("string"))).alias("popularity"))
    return unseen(order, test, train).select("user", "item", F.col("rank").cast("long").alias("rank"))


FITS = """, fits AS (SELECT year(watched_at) AS fold, genre AS feature, round(sum(rating_half) / (1.0 * count(*)) - 5.5, 6) AS weight FROM hist JOIN items USING (item) GROUP BY ALL
), grid AS (SELECT f.fold, g.feature, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT fold FROM fits) f CROSS JOIN (SELECT DISTINCT feature FROM fits) g LEFT JOIN fits USING (fold, feature)
), middles AS (SELECT feature, median(weight) AS middle FROM grid GROUP BY 1)"""


def fits(spark, sf):
    """(fold, feature, weight): how far each genre's ratings of a year lie from the middle of the scale."""
    own = T.history(spark, sf).join(T.items(spark, sf).select("item", "genre"), "item")
    return own.groupBy(F.year("watched_at").alias("fold"), F.col("genre").alias("feature")).agg(F.round(F.sum("rating_half") / F.count("*") - 5.5, 6).alias("weight"))


@query("ag25_weight_stability", T.SQL + FITS + " SELECT feature, round(avg(weight), 5) AS mean, round(stddev_pop(weight), 5) AS sd, count(*) FILTER (sign(weight) = sign(middle)) AS agree, count(*) FILTER (weight <> 0) AS active FROM grid JOIN middles USING (feature) GROUP BY 1")
def weight_stability(spark, sf):
    out = S.stability(fits(spark, sf))
    return out.select("feature", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.col("agree").cast("long").alias("agree"), F.col("active").cast("long").alias("active"))


@query("ag26_median_weights", T.SQL + FITS + " SELECT feature, round(middle, 5) AS weight FROM middles")
def median_weights(spark, sf):
    return S.stability(fits(spark, sf)).select("feature", F.round("middle", 5).alias("weight"))


@query("wn14_ratio_to_median", T.SQL + " SELECT item, round(popularity / median(popularity) OVER (PARTITION BY genre), 6) AS ratio FROM items")
def ratio_to_median(spark, sf):
    return S.ratio_to_median(T.items(spark, sf).select("item", "genre", "popularity"), "popularity", ["genre"]).select("item", F.round("ratio", 6).alias("ratio"))


@query("ag30_page_means", T.SQL + " SELECT user, page, count(*) AS n, round(avg(rating_half / 2.0), 6) AS mean FROM (SELECT user, rating_half, (row_number() OVER (PARTITION BY user ORDER BY watched_at DESC, item) - 1) // 20 AS page FROM custhist) GROUP BY ALL")
def page_means(spark, sf):
    own = T.history(spark, sf, "customer").withColumn("stars", F.col("rating_half") / 2.0)
    return S.page_means(own, "user", [F.desc("watched_at"), F.asc("item")], "stars", 20).select("user", "page", "n", F.round("mean", 6).alias("mean"))


@query("wn16_run_listing", "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def run_listing(spark, sf):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", seq.cast("long").alias("seq"))


@query("sc9_identity_stripped", """WITH names AS (SELECT conv_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'from', 'with', 'that', 'this', 'her', 'his', 'you', 'les', 'der', 'una')))) AS words FROM conversations WHERE turn = 0)
  SELECT conv_id, turn, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda w: CASE WHEN list_contains(words, lower(w)) THEN ' ' ELSE w END), ''), '\\s+', ' ', 'g')) AS text FROM conversations JOIN names USING (conv_id) WHERE turn > 0""")
def identity_stripped(spark, sf):
    """The later turns of each conversation without the words that name the first one."""
    turns = table(spark, sf, "conversations")
    names = turns.where("turn = 0").select("conv_id", S.naming_words(F.col("text")).alias("words"))
    return turns.where("turn > 0").join(names, "conv_id").select("conv_id", "turn", S.without(F.col("text"), F.col("words")).alias("text"))


@query("sc22_numbers", r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '\b(1[89]\d{2}|20[0-3]\d)\b', 1), ',') AS years, array_to_string(regexp_extract_all(text, '(?i)\b(\d{2,3})\s*(?:minutes|minute|mins|min)\b', 1), ',') AS minutes,
  array_to_string(regexp_extract_all(text, '(?i)\b([0-5](?:\.5)?)\s*(?:stars|star)\b', 1), ',') AS stars FROM documents""")
def numbers(spark, sf):
    patterns = {"years": S.YEAR, "minutes": S.MINUTES, "stars": S.STARS}
    return table(spark, sf, "documents").select("doc_id", *(F.array_join(S.found(F.col("text"), p), ",").alias(k) for k, p in patterns.items()))
