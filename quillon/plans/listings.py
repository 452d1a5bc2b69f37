"""Queries: listings, comparisons and small statistics over items, histories and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import listing as L
from quillon.plans import adapter as T
from quillon.plans.registry import query
from quillon.session import table

VOTES = """, votes AS (SELECT item, count(*) AS votes, sum(rating_half) / (2.0 * count(*)) AS mean FROM watches GROUP BY 1)"""


def votes(spark, sf) -> DataFrame:
    """(item, votes, mean): watches of each item and their mean rating in stars."""
    return T.watches(spark, sf, "customer").groupBy("item").agg(F.count("*").alias("votes"), (F.sum("rating_half") / (2.0 * F.count("*"))).alias("mean"))


SORTS = {"popularity": "popularity DESC", "runtime": "runtime", "title": "title", "votes": "votes DESC", "rating": "mean DESC"}


@query("sr1_structural_page", T.SQL + VOTES + " " + " UNION ALL ".join(f"SELECT '{k}' AS sort, item, place FROM (SELECT item, row_number() OVER (ORDER BY {o}, item) AS place FROM items JOIN votes USING (item) WHERE runtime BETWEEN 5 AND 40) WHERE place BETWEEN 21 AND 40" for k, o in SORTS.items()))
def structural_page(spark, sf):
    """The second page of twenty items under each of the five orders."""
    own = T.items(spark, sf).where("runtime between 5 and 40").join(votes(spark, sf), "item")
    orders = {"popularity": F.desc("popularity"), "runtime": F.asc("runtime"), "title": F.asc("title"), "votes": F.desc("votes"), "rating": F.desc("mean")}
    pages = [L.page(own, o, limit=20, offset=20).select(F.lit(k).alias("sort"), "item", F.col("place").cast("long").alias("place")) for k, o in orders.items()]
    return reduce(DataFrame.unionByName, pages)


@query("flt19_title_contains", T.SQL + " SELECT item, title, popularity FROM items WHERE strpos(lower(title), 'an') > 0 OR strpos(title, '%') > 0")
def title_contains(spark, sf):
    return T.items(spark, sf).where(L.contains(F.col("title"), "AN") | L.contains(F.col("title"), "%")).select("item", "title", "popularity")


@query("flt18_ratings_query", T.SQL + """ SELECT user, item, rating_half, CAST(watched_at AS VARCHAR) AS day FROM hist WHERE rating_half BETWEEN 7 AND 10 AND item IN (SELECT item FROM credits WHERE role = 'director' AND person % 3 = 0)
  AND item IN (SELECT item FROM keywords WHERE keyword LIKE '%re%') AND item IN (SELECT item FROM items WHERE runtime >= 10)""")
def ratings_query(spark, sf):
    """Every user's ratings, by clauses on the item's directors, keywords and runtime; each clause is a semi-join."""
    clauses = [T.credits(spark, sf).where("role = 'director' and person % 3 = 0"), T.keywords(spark, sf).where(L.contains(F.col("keyword"), "re")), T.items(spark, sf).where("runtime >= 10")]
    own = L.having_all(T.history(spark, sf).where("rating_half between 7 and 10"), clauses)
    return own.select("user", "item", "rating_half", F.col("watched_at").cast("string").alias("day"))


@query("flt22_lookback", """WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS day, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS week, count(*) FILTER (ts >= now - INTERVAL 30 MINUTE) AS half_hour FROM events, m GROUP BY 1""")
def lookback(spark, sf):
    e = table(spark, sf, "events")
    return L.lookback(e, "ts", {"day": "24 hours", "week": "7 days", "half_hour": "30 minutes"}, ["event_type"])


@query("flt24_cutoff", T.SQL + " SELECT user, item, rating_half FROM custhist WHERE watched_at < DATE '1998-06-01'")
def cutoff(spark, sf):
    return L.before(T.history(spark, sf, "customer"), "watched_at", "1998-06-01").select("user", "item", "rating_half")


@query("wn12_recent_history", T.SQL + " SELECT user, item, CAST(watched_at AS VARCHAR) AS day FROM custhist QUALIFY row_number() OVER (PARTITION BY user ORDER BY watched_at DESC, item) <= 15")
def recent_history(spark, sf):
    return L.most_recent(T.history(spark, sf, "customer"), 15, ["user"], "watched_at", "item").select("user", "item", F.col("watched_at").cast("string").alias("day"))


@query("jn22_shared_attributes", T.SQL + """, k AS (SELECT item, list_sort(list(keyword)) AS ks FROM keywords GROUP BY 1), p AS (SELECT item, list_sort(list(person)) AS ps FROM credits GROUP BY 1)
  SELECT a.item AS left_item, b.item AS right_item, array_to_string(list_sort(list_intersect(a.ks, b.ks)), ',') AS shared_keywords, len(list_intersect(p.ps, q.ps)) AS shared_people, len(list_distinct(list_concat(a.ks, b.ks))) AS all_keywords
  FROM k a JOIN k b ON b.item = a.item + 1 JOIN p ON p.item = a.item JOIN p q ON q.item = b.item""")
def shared_attributes(spark, sf):
    """Each item compared with the next one: what they share and what either has."""
    k = T.keywords(spark, sf).groupBy("item").agg(F.collect_set("keyword").alias("keywords"))
    p = T.credits(spark, sf).groupBy("item").agg(F.collect_set("person").alias("people"))
    own = k.join(p, "item")
    out = L.compared(own, T.items(spark, sf).select(F.col("item").alias("left_item"), (F.col("item") + 1).alias("right_item")), ["keywords", "people"])
    return out.select("left_item", "right_item", F.array_join("shared_keywords", ",").alias("shared_keywords"), F.size("shared_people").cast("long").alias("shared_people"), F.size("all_keywords").cast("long").alias("all_keywords"))


@query("jn7_home_country", T.SQL + " SELECT item, coalesce((SELECT country FROM countries c WHERE c.item = i.item ORDER BY country LIMIT 1), -1) AS country FROM items i")
def home_country(spark, sf):
    first = T.countries(spark, sf).groupBy("item").agg(F.min("country").alias("country"))
    return T.items(spark, sf).select("item").join(first, "item", "left").select("item", F.coalesce("country", F.lit(-1)).alias("country"))


@query("ag8_concat_round_trip", T.SQL + " SELECT item, string_agg(keyword, '|' ORDER BY keyword) AS names, count(*) AS n FROM keywords GROUP BY 1")
def concat_round_trip(spark, sf):
    names = T.keywords(spark, sf).groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("keyword")), "|").alias("names"))
    return names.select("item", "names", F.size(F.split("names", r"\|")).cast("long").alias("n"))


@query("ag23_title_descriptors", T.SQL + " SELECT keyword AS word, count(*) AS n FROM keywords GROUP BY 1 ORDER BY n DESC, word LIMIT 12")
def title_descriptors(spark, sf):
    return T.keywords(spark, sf).groupBy(F.col("keyword").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(12)


@query("sc4_year_proximity", T.SQL + """, years AS (SELECT item, list(DISTINCT year(watched_at)) AS ys FROM watches GROUP BY 1)
  SELECT item, list_min(list_transform(ys, lambda y: abs(y - (1994 + item % 9)))) AS drift, round(CASE WHEN ys IS NULL THEN 0.5 ELSE greatest(0.0, 1 - list_min(list_transform(ys, lambda y: abs(y - (1994 + item % 9)))) / 4.0) END, 6) AS proximity FROM items LEFT JOIN years USING (item)""")
def year_proximity(spark, sf):
    years = T.watches(spark, sf, "customer").groupBy("item").agg(F.collect_set(F.year("watched_at")).alias("years"))
    drift = L.year_drift(F.col("years"), 1994 + F.col("item") % 9)
    return T.items(spark, sf).join(years, "item", "left").select("item", drift.alias("drift"), F.round(L.year_proximity(drift), 6).alias("proximity"))


@query("sc5_vote_weight", T.SQL + VOTES + " SELECT item, round(least(1.0, ln(1 + votes) / ln(200001)), 6) AS weight, round(0.6 + greatest(0.0, least(1.0, (mean - 2.0) / 1.5)) * 0.3, 6) AS band FROM votes")
def vote_weight(spark, sf):
    return votes(spark, sf).select("item", F.round(L.vote_weight(F.col("votes")), 6).alias("weight"), F.round(L.band(F.col("mean"), 2.0, 3.5, 0.6, 0.9), 6).alias("band"))


@query("sr6_era_baseline", T.SQL + """, era AS (SELECT user, arg_max(decade, (n, -decade)) AS decade FROM (SELECT user, runtime // 10 AS decade, count(*) AS n FROM hist JOIN items USING (item) WHERE rating_half >= 8 GROUP BY ALL) GROUP BY 1)
  SELECT user, item, rank FROM (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY CASE WHEN runtime // 10 = decade THEN 0 ELSE 1 END, popularity DESC, item) AS rank FROM era, items) WHERE rank <= 20""")
def era_baseline(spark, sf):
    """Each user's most popular items, those of the decade that the user likes most first: one ranking for each decade, shared by its users."""
    items = T.items(spark, sf).withColumn("decade", F.expr("runtime div 10"))
    liked = T.history(spark, sf).where("rating_half >= 8").join(items.select("item", "decade"), "item").groupBy("user", "decade").agg(F.count("*").alias("n"))
    era = liked.groupBy("user").agg(F.max(F.struct("n", (-F.col("decade")).alias("o"))).alias("b")).select("user", (-F.col("b.o")).alias("decade"))
    best = L.preferred_first(items, era.select("decade").distinct(), "decade", 20)
    return era.join(best, "decade").select("user", "item", F.col("rank").cast("long").alias("rank"))


@query("sc27_borda", T.SQL + " SELECT item, round(avg(CASE WHEN n > 1 THEN (n - 1 - pos) / (n - 1.0) ELSE 1.0 END), 6) AS points FROM (SELECT item, row_number() OVER (PARTITION BY user ORDER BY rating_half DESC, item) - 1 AS pos, count(*) OVER (PARTITION BY user) AS n FROM custhist) GROUP BY 1")
def borda(spark, sf):
    """Items by the mean of their points over all users' orders."""
    order = Window.partitionBy("user").orderBy(F.desc("rating_half"), "item")
    placed = T.history(spark, sf, "customer").select("item", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(Window.partitionBy("user")).alias("n"))
    return placed.groupBy("item").agg(F.round(F.avg(L.borda(F.col("pos"), F.col("n"))), 6).alias("points"))


@query("wn17_position_windows", """WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, n, unnest(CASE WHEN n <= 4 THEN [0] ELSE list_distinct(list_append(list_filter(range(0, n, 2), lambda x: x + 4 <= n), n - 4)) END) AS begin FROM s)
  SELECT conv_id, CAST(begin AS BIGINT) AS first, CAST(least(begin + 4, n) AS BIGINT) AS stop FROM w""")
def position_windows(spark, sf):
    """Windows of four turns, two apart, over each conversation; the last one ends with it."""
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return L.windows(sizes, "n", 4, 2).select("conv_id", F.col("first").cast("long").alias("first"), F.col("stop").cast("long").alias("stop"))


@query("sr13_newest_first", T.SQL + " SELECT item, CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day DESC NULLS LAST, item) AS place FROM (SELECT item, max(watched_at) FILTER (rating_half = 10) AS day FROM watches GROUP BY 1) ORDER BY place LIMIT 100")
def newest_first(spark, sf):
    days = T.watches(spark, sf, "customer").groupBy("item").agg(F.max(F.when(F.col("rating_half") == 10, F.col("watched_at"))).alias("day"))
    return L.page(days, F.desc_nulls_last("day"), limit=100).select("item", F.col("day").cast("string").alias("day"), F.col("place").cast("long").alias("place"))


@query("ag24_pooled_metrics", T.SQL + " SELECT role, count(*) AS n, round(avg(k), 6) AS mean, CAST(sum(k) AS BIGINT) AS total, round(median(k), 6) AS p50 FROM (SELECT role, person, count(*) AS k FROM credits GROUP BY ALL) GROUP BY 1")
def pooled(spark, sf):
    own = T.credits(spark, sf).groupBy("role", "person").agg(F.count("*").alias("k"))
    return own.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.sum("k").alias("total"), F.round(F.median("k"), 6).alias("p50"))
