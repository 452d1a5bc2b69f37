"""Queries: hard filters, channels, fusion, features and the flagship recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import affinity as A
from quillon.operators import filters as H
from quillon.operators import knn, lexical, quantiles, ranking
from quillon.plans import adapter as T
from quillon.plans.registry import query
from quillon.session import table
from quillon.storage import written

USER = 3
FILTERS = H.HardFilters(runtime_min=5, runtime_max=45, popularity_min=905.0, include={"countries": frozenset({1, 2, 3, 4, 5, 6, 7, 8})}, exclude={"keywords": frozenset({"red", "blue"}), "people": frozenset({7})}, exclude_ids=frozenset({11, 12}))

#: The same clauses for the oracle.
FLAGS = """, flags AS (
  SELECT item, title, genre, collection, runtime, popularity, coalesce(runtime >= 5, false) AS runtime_min, coalesce(runtime <= 45, false) AS runtime_max, coalesce(popularity >= 905, false) AS popularity_min,
    item IN (SELECT item FROM countries WHERE country BETWEEN 1 AND 8) AS include_countries, item NOT IN (SELECT item FROM keywords WHERE keyword IN ('red', 'blue')) AS exclude_keywords,
    item NOT IN (SELECT item FROM credits WHERE person = 7) AS exclude_people, item NOT IN (11, 12) AS exclude_ids, item NOT IN (SELECT item FROM hist WHERE user = 3) AS exclude_watched
  FROM items
), passing AS (
  SELECT * FROM flags WHERE runtime_min AND runtime_max AND popularity_min AND include_countries AND exclude_keywords AND exclude_people AND exclude_ids AND exclude_watched
), removed AS (
  SELECT unnest(['runtime_min', 'runtime_max', 'popularity_min', 'include_countries', 'exclude_keywords', 'exclude_people', 'exclude_ids', 'exclude_watched', 'all']) AS clause,
    unnest([count(*) FILTER (NOT runtime_min), count(*) FILTER (NOT runtime_max), count(*) FILTER (NOT popularity_min), count(*) FILTER (NOT include_countries), count(*) FILTER (NOT exclude_keywords), count(*) FILTER (NOT exclude_people),
      count(*) FILTER (NOT exclude_ids), count(*) FILTER (NOT exclude_watched), count(*) - (SELECT count(*) FROM passing)]) AS removed FROM flags
)"""


def bridges(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"countries": T.countries(spark, sf), "keywords": T.keywords(spark, sf), "people": T.credits(spark, sf)}


def seen(spark: SparkSession, sf: str) -> DataFrame:
    return T.history(spark, sf).where(F.col("user") == USER)


@query("flt_allow_set", T.SQL + FLAGS + " SELECT item, title, genre, collection, runtime, popularity FROM passing")
def allow_set(spark, sf):
    return H.allowed(T.items(spark, sf), FILTERS, bridges(spark, sf), seen(spark, sf))


@query("flt_clause_attribution", T.SQL + FLAGS + " SELECT clause, removed FROM removed")
def clause_attribution(spark, sf):
    return H.attribution(T.items(spark, sf), FILTERS, bridges(spark, sf), seen(spark, sf))


@query("flt_most_restrictive", T.SQL + FLAGS + " SELECT clause, removed FROM removed WHERE clause <> 'all' ORDER BY removed DESC, clause LIMIT 1")
def most_restrictive(spark, sf):
    return H.most_restrictive(H.attribution(T.items(spark, sf), FILTERS, bridges(spark, sf), seen(spark, sf)))


@query("flt_impossible_includes", T.SQL + " SELECT clause, removed FROM (SELECT unnest(['include_genres', 'exclude_watched', 'all']) AS clause, unnest([count(*), count(*) FILTER (item IN (SELECT item FROM hist WHERE user = 3)), count(*)]) AS removed FROM items)")
def impossible(spark, sf):
    a, b = H.HardFilters(include={"genres": frozenset({"ECONOMY"})}), H.HardFilters(include={"genres": frozenset({"PROMO"})})
    return H.attribution(T.items(spark, sf), a.merge(b), bridges(spark, sf), seen(spark, sf))


VERDICT = """ SELECT item, CASE WHEN n < 10 THEN 'few_watches' WHEN runtime < 5 THEN 'too_short' WHEN popularity < 903 THEN 'unpopular' END AS reason,
  CASE WHEN runtime IS NULL THEN -1 WHEN runtime < 10 THEN 0 WHEN runtime < 20 THEN 1 WHEN runtime < 30 THEN 2 WHEN runtime < 40 THEN 3 ELSE 4 END AS bucket, (runtime // 10) * 10 AS decade,
  CASE WHEN home IN ('1', '2') THEN CASE WHEN 1950 + runtime < 1980 THEN 5 WHEN 1950 + runtime < 2000 THEN 10 ELSE 25 END ELSE greatest(3, CASE WHEN 1950 + runtime < 1980 THEN 5 WHEN 1950 + runtime < 2000 THEN 10 ELSE 25 END // 2) END AS vote_floor
FROM items LEFT JOIN (SELECT item, count(*) AS n FROM watches GROUP BY 1) USING (item) LEFT JOIN (SELECT item, CAST(min(country) AS VARCHAR) AS home FROM countries GROUP BY 1) USING (item)"""


@query("flt_eligibility_verdict", T.SQL + VERDICT)
def eligibility(spark, sf):
    n = T.watches(spark, sf, "customer").groupBy("item").agg(F.count("*").alias("n"))
    home = T.countries(spark, sf).groupBy("item").agg(F.min("country").cast("string").alias("home"))
    base = T.items(spark, sf).join(n, "item", "left").join(home, "item", "left")
    rules = [(F.col("n") < 10, "few_watches"), (F.col("runtime") < 5, "too_short"), (F.col("popularity") < 903, "unpopular")]
    return base.select(
        "item", H.verdict(rules).alias("reason"), H.bucket(F.col("runtime"), (10, 20, 30, 40)).alias("bucket"), F.expr("runtime div 10 * 10").cast("int").alias("decade"),
        H.vote_floor(1950 + F.col("runtime"), F.col("home"), ("1", "2")).alias("vote_floor"),
    )


@query("st_union_targets", T.SQL + " SELECT count(*) AS n, CAST(sum(item) AS BIGINT) AS total FROM (SELECT item FROM items WHERE popularity > 950 UNION SELECT item FROM custhist)")
def union_targets(spark, sf):
    liked = T.items(spark, sf).where("popularity > 950").select("item").union(T.history(spark, sf, "customer").select("item"))
    return liked.distinct().agg(F.count("*").alias("n"), F.sum("item").alias("total"))


@query("st_index_orphans", T.SQL + " SELECT (SELECT count(*) FROM items ANTI JOIN vectors USING (item)) AS missing, (SELECT count(*) FROM vectors ANTI JOIN items USING (item)) AS orphans, (SELECT count(*) FROM vectors) AS n, (SELECT min(len(v)) FROM vectors) AS least_width, (SELECT max(len(v)) FROM vectors) AS most_width")
def index_orphans(spark, sf):
    i, v = T.items(spark, sf).select("item"), T.vectors(spark, sf)
    counts = [i.join(v, "item", "left_anti").agg(F.count("*").alias("missing")), v.join(i, "item", "left_anti").agg(F.count("*").alias("orphans")), v.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least_width"), F.max(F.size("v")).alias("most_width"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def asked(spark, sf, sql="item % 50 = 0") -> DataFrame:
    return T.vectors(spark, sf).where(sql).select(F.col("item").alias("query"), F.col("v").alias("q"))


KNN = " SELECT query, item, round(score, 6) AS score, rank FROM (SELECT q.item AS query, x.item, list_cosine_similarity(x.v, q.v) AS score, row_number() OVER (PARTITION BY q.item ORDER BY list_cosine_similarity(x.v, q.v) DESC, x.item) AS rank FROM vectors x, vectors q WHERE q.item % 50 = 0 {where}) WHERE rank <= 10"


@query("vx_knn", T.SQL + KNN.format(where="AND x.item <> q.item"))
def knn_all(spark, sf):
    return knn.nearest(T.vectors(spark, sf), asked(spark, sf), 10, exclude_self=True).select("query", "item", F.round("score", 6).alias("score"), "rank")


@query("vx_knn_filtered", T.SQL + KNN.format(where="AND x.item IN (SELECT item FROM items WHERE runtime BETWEEN 10 AND 30)"))
def knn_filtered(spark, sf):
    allow = T.items(spark, sf).where("runtime between 10 and 30")
    return knn.nearest(T.vectors(spark, sf), asked(spark, sf), 10, allow).select("query", "item", F.round("score", 6).alias("score"), "rank")


CENTROIDS = """, cent AS (SELECT label AS mode, list(s ORDER BY d) AS q FROM (SELECT label, d, sum(x) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vectors) GROUP BY ALL) GROUP BY 1)"""


def modes(spark, sf) -> DataFrame:
    own = T.vectors(spark, sf)
    return knn.centroid(own.select("item", "v"), own.select(F.col("label").alias("mode"), "item", F.lit(1.0).alias("w")), ["mode"])


@query("rt1_dense_mode_channel", T.SQL + CENTROIDS + " SELECT mode, item, round(score, 6) AS score, rank FROM (SELECT mode, item, list_cosine_similarity(v, q) AS score, row_number() OVER (PARTITION BY mode ORDER BY list_cosine_similarity(v, q) DESC, item) AS rank FROM vectors, cent) WHERE rank <= 20")
def dense_mode(spark, sf):
    q = modes(spark, sf).select(F.col("mode").alias("query"), "q")
    return knn.nearest(T.vectors(spark, sf), q, 20).select(F.col("query").alias("mode"), "item", F.round("score", 6).alias("score"), "rank")


@query("rt13_mode_assignment", T.SQL + CENTROIDS + " SELECT item, arg_max(mode, (c, -mode)) AS mode, round(max(c), 6) AS cosine FROM (SELECT item, mode, list_cosine_similarity(v, q) AS c FROM vectors, cent) GROUP BY 1")
def mode_assignment(spark, sf):
    return knn.assigned(T.vectors(spark, sf), modes(spark, sf)).select("item", "mode", F.round("cosine", 6).alias("cosine"))


@query("sc19_mode_affinity", T.SQL + CENTROIDS + " SELECT item, round(0.05 * (max(t) + ln(sum(exp(t - peak)))), 6) AS affinity FROM (SELECT item, t, max(t) OVER (PARTITION BY item) AS peak FROM (SELECT item, list_cosine_similarity(v, q) / 0.05 + ln(1.0 / (mode + 2)) AS t FROM vectors, cent)) GROUP BY 1")
def mode_affinity(spark, sf):
    m = modes(spark, sf).withColumn("confidence", 1.0 / (F.col("mode") + 2))
    return knn.smooth_affinity(T.vectors(spark, sf), m).select("item", F.round("affinity", 6).alias("affinity"))


@query("sc18_query_mode_posterior", T.SQL + CENTROIDS + " SELECT query, mode, round(e / sum(e) OVER (PARTITION BY query), 6) AS posterior FROM (SELECT query, mode, exp((c - max(c) OVER (PARTITION BY query)) / 0.07) AS e FROM (SELECT item AS query, mode, list_cosine_similarity(v, q) AS c FROM vectors, cent WHERE item % 50 = 0))")
def posterior(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("query")
    c = asked(spark, sf).withColumnRenamed("q", "v").crossJoin(F.broadcast(modes(spark, sf))).select("query", "mode", V.cosine(F.col("v"), F.col("q")).alias("c"))
    e = c.withColumn("e", F.exp((F.col("c") - F.max("c").over(w)) / 0.07))
    return e.select("query", "mode", F.round(F.col("e") / F.sum("e").over(w), 6).alias("posterior"))


WORDS = r"regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+')"
BM25 = f""", tok AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (
  SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'the')) AS c0, len(list_filter(w, lambda x: x = 'sting')) AS c1, len(list_filter(w, lambda x: x = 'und')) AS c2, list_contains(w, 'worthless') AS bad FROM tok
), s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1, count(*) FILTER (c2 > 0) AS d2 FROM c), hit AS (
  SELECT doc_id, bad, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * length / mean))
    + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * c2 * 2.2 / (c2 + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM c, s WHERE c0 + c1 + c2 > 0
)"""


@query("lx2_bm25_search", T.SQL + BM25 + " SELECT doc_id, round(score, 6) AS score FROM hit ORDER BY score DESC, doc_id LIMIT 50")
def bm25(spark, sf):
    return lexical.bm25(table(spark, sf, "documents"), "The sting, und", 50).select("doc_id", F.round("score", 6).alias("score"))


@query("lx3_bm25_negation", T.SQL + BM25 + " SELECT doc_id, round(score, 6) AS score FROM hit WHERE NOT bad ORDER BY score DESC, doc_id LIMIT 50")
def bm25_negation(spark, sf):
    return lexical.bm25(table(spark, sf, "documents"), "The sting, und", 50, exclude="worthless").select("doc_id", F.round("score", 6).alias("score"))


@query("lx1_postings", T.SQL + f" SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL")
def postings(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), {"text": 1.0})


ENTITIES = """, ent AS (
  SELECT role AS kind, CAST(person AS VARCHAR) AS entity, item FROM credits UNION ALL SELECT 'keyword', keyword, item FROM keywords UNION ALL SELECT 'genre', genre, item FROM items
  UNION ALL SELECT 'country', CAST(country AS VARCHAR), item FROM countries UNION ALL SELECT 'collection', collection, item FROM items UNION ALL SELECT 'runtime', CAST(runtime // 10 AS VARCHAR), item FROM items
), sig AS (
  SELECT user, item, rating_half, (rating_half / 2.0 - m) / s AS z FROM hist JOIN (SELECT user, avg(rating_half / 2.0) AS m, greatest(stddev_pop(rating_half / 2.0), 0.35) AS s FROM hist GROUP BY 1) USING (user)
), aff AS (
  SELECT user, kind, entity, n, raw, kappa, corpus_n, watched, total FROM (SELECT user, kind, entity, count(*) AS n, sum(z) AS raw FROM sig JOIN ent USING (item) GROUP BY ALL)
  JOIN (SELECT kind, entity, count(DISTINCT item) AS corpus_n FROM ent GROUP BY ALL) USING (kind, entity) JOIN (SELECT user, count(*) AS watched FROM hist GROUP BY 1) USING (user)
  JOIN (VALUES ('director', 2.0), ('writer', 3.0), ('actor', 4.0), ('keyword', 6.0), ('genre', 8.0), ('country', 5.0), ('runtime', 6.0), ('collection', 2.0)) k(kind, kappa) USING (kind), (SELECT count(DISTINCT item) AS total FROM ent)
  WHERE n >= CASE WHEN kind IN ('keyword', 'actor') THEN 2 ELSE 1 END
)"""


def entities(spark, sf) -> DataFrame:
    i = T.items(spark, sf)
    parts = [
        T.credits(spark, sf).select(F.col("role").alias("kind"), F.col("person").cast("string").alias("entity"), "item"), T.keywords(spark, sf).select(F.lit("keyword").alias("kind"), F.col("keyword").alias("entity"), "item"),
        i.select(F.lit("genre").alias("kind"), F.col("genre").alias("entity"), "item"), T.countries(spark, sf).select(F.lit("country").alias("kind"), F.col("country").cast("string").alias("entity"), "item"),
        i.select(F.lit("collection").alias("kind"), F.col("collection").alias("entity"), "item"), i.select(F.lit("runtime").alias("kind"), F.expr("cast(runtime div 10 as string)").alias("entity"), "item"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("tm10_affinities", T.SQL + ENTITIES + """ SELECT user, kind, entity, n, round(raw / (n + kappa), 6) AS affinity, round(ln(mine / (1 - mine)) - ln(base / (1 - base)), 6) AS exposure FROM (
  SELECT *, greatest(1e-6, least(1 - 1e-6, (n + kappa * base) / (watched + kappa))) AS mine FROM (SELECT *, least(greatest(corpus_n, 0.5) / total, 1 - 1e-6) AS base FROM aff))""")
def affinities(spark, sf):
    out = A.affinities(A.signals(T.history(spark, sf)), entities(spark, sf), support=False)
    return out.select("user", "kind", "entity", "n", F.round("affinity", 6).alias("affinity"), F.round("exposure", 6).alias("exposure"))


@query("ag18_support_items", T.SQL + ENTITIES + " SELECT user, entity, array_to_string(list(item ORDER BY rn), ',') AS support FROM (SELECT user, entity, item, row_number() OVER (PARTITION BY user, entity ORDER BY round(abs(z), 9) DESC, item) AS rn FROM sig JOIN ent USING (item) WHERE kind = 'genre') WHERE rn <= 12 GROUP BY ALL")
def support(spark, sf):
    out = A.affinities(A.signals(T.history(spark, sf)), entities(spark, sf).where("kind = 'genre'"))
    return out.select("user", "entity", F.array_join(F.col("support").cast("array<string>"), ",").alias("support"))


CHANNELS = """, liked AS (
  SELECT kind, entity, round(raw / (n + kappa), 9) * CASE kind WHEN 'writer' THEN 0.6 WHEN 'actor' THEN 0.5 ELSE 1.0 END AS w, row_number() OVER (PARTITION BY kind ORDER BY round(raw / (n + kappa), 9) DESC, entity) AS r FROM aff WHERE user = 3 AND raw > 0 AND kind IN ('director', 'writer', 'actor', 'keyword')
), ppl AS (
  SELECT item, max(w) AS score FROM liked JOIN ent USING (kind, entity) WHERE kind <> 'keyword' AND r <= 80 AND item NOT IN (SELECT item FROM hist WHERE user = 3) GROUP BY 1
), kw AS (
  SELECT item, max(w) AS score FROM liked JOIN ent USING (kind, entity) WHERE kind = 'keyword' AND r <= 120 AND item NOT IN (SELECT item FROM hist WHERE user = 3) GROUP BY 1
), pop AS (SELECT item, popularity AS score FROM items WHERE item NOT IN (SELECT item FROM hist WHERE user = 3)
), qv AS (SELECT list(s ORDER BY d) AS q FROM (SELECT d, sum(z * x) AS s FROM (SELECT z, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM sig JOIN vectors USING (item) WHERE user = 3 AND z > 0) GROUP BY 1)
), dense AS (SELECT item, round(list_cosine_similarity(v, q), 9) AS score FROM vectors, qv WHERE item IN (SELECT item FROM items) AND item NOT IN (SELECT item FROM hist WHERE user = 3)
), hits AS (
  SELECT * FROM (SELECT 'people' AS channel, item, row_number() OVER (ORDER BY score DESC, item) AS rank, score FROM ppl) WHERE rank <= 300 UNION ALL SELECT * FROM (SELECT 'keyword', item, row_number() OVER (ORDER BY score DESC, item) AS rank, score FROM kw) WHERE rank <= 300
  UNION ALL SELECT * FROM (SELECT 'popular', item, row_number() OVER (ORDER BY score DESC, item) AS rank, score FROM pop) WHERE rank <= 200 UNION ALL SELECT * FROM (SELECT 'dense', item, row_number() OVER (ORDER BY score DESC, item) AS rank, score FROM dense) WHERE rank <= 400
), rrf AS (SELECT item, sum(CASE WHEN channel = 'popular' THEN 0.5 ELSE 1.0 END / (60 + rank)) AS rrf, list_sort(list(DISTINCT channel)) AS channels FROM hits GROUP BY 1)"""


def channels(spark, sf, allow: DataFrame | None = None) -> list[DataFrame]:
    """The four channels for one user: people, keywords, popular and nearest to what was liked. Each is cut within the allowed items (all unseen ones, if none are given)."""
    own = T.history(spark, sf)
    sig = A.signals(own)
    unseen = T.items(spark, sf).join(seen(spark, sf), "item", "left_anti") if allow is None else allow
    ent = entities(spark, sf).where("kind in ('director', 'writer', 'actor', 'keyword')")
    # the log odds need the corpus; here the shrunken means of one user do
    mine = sig.where(F.col("user") == USER)
    kappa = F.create_map(*(x for k, v in A.KAPPA.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    least = F.when(F.col("kind").isin("keyword", "actor"), 2).otherwise(1)
    aff = mine.join(ent, "item").groupBy("kind", "entity").agg(F.count("*").alias("n"), F.sum("z").alias("raw")).where(F.col("n") >= least).where("raw > 0")
    aff = aff.withColumn("affinity", F.round(F.col("raw") / (F.col("n") + kappa), 9))
    liked = ranking.ranked(aff, 120, "affinity", ["kind"], "entity").where("kind = 'keyword' or rank <= 80")
    w = F.col("affinity") * F.when(F.col("kind") == "writer", 0.6).when(F.col("kind") == "actor", 0.5).otherwise(1.0)
    met = liked.select("kind", "entity", w.alias("w")).join(ent, ["kind", "entity"]).join(unseen.select("item"), "item", "left_semi")
    people, words = (met.where(c).groupBy("item").agg(F.max("w").alias("score")) for c in ("kind <> 'keyword'", "kind = 'keyword'"))
    q = knn.centroid(T.vectors(spark, sf).select("item", "v"), mine.where("z > 0").select(F.lit(0).alias("g"), "item", F.col("z").alias("w")), ["g"])
    dense = T.vectors(spark, sf).join(unseen.select("item"), "item", "left_semi").crossJoin(F.broadcast(q)).select("item", F.round(V.cosine(F.col("v"), F.col("q")), 9).alias("score"))
    return [ranking.top(people, 300, "people"), ranking.top(words, 300, "keyword"), ranking.top(unseen, 200, "popular", "popularity"), ranking.top(dense, 400, "dense")]


@query("rt4_channels", T.SQL + ENTITIES + CHANNELS + " SELECT channel, item, rank, round(score, 6) AS score FROM hits")
def channel_hits(spark, sf):
    out = channels(spark, sf)
    every = out[0]
    for c in out[1:]:
        every = every.unionByName(c)
    return every.select("channel", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("rt7_rrf_pool", T.SQL + ENTITIES + CHANNELS + " SELECT item, round(rrf, 9) AS rrf, array_to_string(channels, ',') AS channels FROM rrf ORDER BY round(rrf, 9) DESC, item LIMIT 1200")
def pool(spark, sf):
    fused = ranking.fused(channels(spark, sf), weights={"popular": 0.5}).withColumn("rrf", F.round("rrf", 9))
    return fused.orderBy(F.desc("rrf"), "item").limit(1200).select("item", "rrf", F.array_join("channels", ",").alias("channels"))


@query("ag22_unique_to_channel", T.SQL + ENTITIES + CHANNELS + " SELECT channels[1] AS channel, count(*) AS n FROM rrf WHERE len(channels) = 1 GROUP BY 1")
def unique(spark, sf):
    return ranking.unique_to_channel(ranking.fused(channels(spark, sf), weights={"popular": 0.5}))


FEATURES = """, cnt AS (SELECT item, count(*) AS votes, avg(rating_half / 2.0) AS mean FROM custhist GROUP BY 1), val AS (
  SELECT 'popularity' AS feature, item, ln(1 + greatest(popularity, 0)) AS value FROM items UNION ALL SELECT 'vote_quality', item, votes / (votes + 200.0) * mean + (1 - votes / (votes + 200.0)) * (SELECT avg(mean) FROM cnt) FROM cnt
  UNION ALL SELECT 'runtime', item, runtime FROM items WHERE runtime <= 45 UNION ALL SELECT 'flag', item, CASE WHEN runtime = 7 THEN 1.0 ELSE 0.0 END FROM items UNION ALL SELECT 'few', item, item FROM items WHERE item < 7 UNION ALL SELECT 'same', item, 3.0 FROM items
), mid AS (SELECT feature, median(value) AS m, count(*) AS n, min(value) AS lo, max(value) AS hi FROM val GROUP BY 1), sp AS (SELECT feature, 1.4826 * median(abs(value - m)) AS s FROM val JOIN mid USING (feature) GROUP BY 1), sc AS (
  SELECT feature, item, how, greatest(-3.0, least(3.0, CASE how WHEN 'mad' THEN (value - m) / s WHEN 'rank' THEN 2.0 * r / (n - 1) - 1 ELSE 0.0 END)) AS scaled FROM (
    SELECT *, CASE WHEN n < 8 THEN 'zeroed' WHEN s > 1e-9 THEN 'mad' WHEN lo = hi THEN 'zeroed' ELSE 'rank' END AS how, rank() OVER (PARTITION BY feature ORDER BY value) - 1 + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM val JOIN mid USING (feature) JOIN sp USING (feature))
)"""


def features(spark, sf) -> DataFrame:
    i = T.items(spark, sf)
    q = A.vote_quality(T.history(spark, sf, "customer"))
    row = lambda name, df, value: df.select(F.lit(name).alias("feature"), "item", value.cast("double").alias("value"))
    parts = [row("popularity", i, F.log1p(F.greatest(F.col("popularity"), F.lit(0.0)))), row("vote_quality", q, F.col("quality")), row("runtime", i.where("runtime <= 45"), F.col("runtime")), row("flag", i, F.when(F.col("runtime") == 7, 1.0).otherwise(0.0)), row("few", i.where("item < 7"), F.col("item")), row("same", i, F.lit(3.0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rt10_scaled_features", T.SQL + FEATURES + " SELECT feature, item, how, round(scaled, 6) AS scaled FROM sc")
def scaled(spark, sf):
    return quantiles.scaled(written(features(spark, sf), "features"), ["feature"]).select("feature", "item", "how", F.round("scaled", 6).alias("scaled"))


@query("rt12_linear_score", T.SQL + FEATURES + " SELECT item, round(sum(CASE feature WHEN 'popularity' THEN 0.4 WHEN 'vote_quality' THEN 0.8 WHEN 'runtime' THEN -0.1 ELSE 0.0 END * scaled) + 0.05, 6) AS score FROM sc GROUP BY 1")
def linear(spark, sf):
    out = ranking.linear(quantiles.scaled(written(features(spark, sf), "features"), ["feature"]), {"popularity": 0.4, "vote_quality": 0.8, "runtime": -0.1}, 0.05)
    return out.select("item", F.round("score", 6).alias("score"))


RECOMMEND = " SELECT item, title, round(rrf, 9) AS rrf, array_to_string(channels, ',') AS channels FROM rrf JOIN passing USING (item) ORDER BY round(rrf, 9) DESC, item LIMIT 10"


@query("rt28_recommend", T.SQL + FLAGS + ENTITIES + CHANNELS.replace("item NOT IN (SELECT item FROM hist WHERE user = 3)", "item IN (SELECT item FROM passing)") + RECOMMEND)
def recommend(spark, sf, filters: H.HardFilters = FILTERS):
    """For one user the ten best items of the fused channels. The hard filters come before every channel's cut, so a narrow filter still fills the list."""
    allow = H.allowed(T.items(spark, sf), filters, bridges(spark, sf), seen(spark, sf))
    fused = ranking.fused(channels(spark, sf, allow), weights={"popular": 0.5}).join(allow.select("item", "title"), "item").withColumn("rrf", F.round("rrf", 9))
    return fused.orderBy(F.desc("rrf"), "item").limit(10).select("item", "title", "rrf", F.array_join("channels", ",").alias("channels"))


NORMAL = "regexp_replace(trim(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+', ' ', 'g')), '^(the|a|an|le|la|les|un|une|der|die|das|el|los|las|il|lo) (.)', '\\2')"


COSTS = T.SQL + FLAGS + ENTITIES + CHANNELS + ", scored AS (SELECT f.*, round(rrf, 9) AS score FROM rrf JOIN flags f USING (item))"
CLAUSES = ["runtime_min", "runtime_max", "popularity_min", "include_countries", "exclude_keywords", "exclude_people", "exclude_ids"]
OTHERS = {c: " AND ".join(o for o in CLAUSES if o != c) for c in CLAUSES}


def flagged_scores(spark, sf) -> DataFrame:
    """Every unseen item of the fused channels with its score and whether it passes each clause."""
    fused = ranking.fused(channels(spark, sf), weights={"popular": 0.5}).select("item", F.round("rrf", 9).alias("score"))
    return fused.join(H.flagged(T.items(spark, sf), FILTERS, bridges(spark, sf), seen(spark, sf)), "item")


@query("flt26_clause_costs", COSTS + ", head AS (SELECT * FROM scored ORDER BY score DESC, item LIMIT 10) SELECT clause, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS clause, count(*) FILTER (NOT {c}) AS n FROM head WHERE NOT ({' AND '.join(CLAUSES)})" for c in CLAUSES) + ") WHERE n > 0")
def clause_costs(spark, sf):
    """Of the ten best items without the optional clauses, how many each clause removes."""
    scored = flagged_scores(spark, sf)
    return H.head_costs(scored, CLAUSES, scored.where(H.every(CLAUSES)))


@query("flt26_without_each_clause", COSTS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS clause, item, row_number() OVER (ORDER BY score DESC, item) AS rank, NOT {c} AS gained FROM scored WHERE {OTHERS[c]} QUALIFY rank <= 10" for c in CLAUSES) + ")")
def without_each(spark, sf):
    """The ten best items if each clause alone weren't there, all from one scan."""
    return H.without_each(flagged_scores(spark, sf), CLAUSES).select("clause", "item", F.col("rank").cast("long").alias("rank"), "gained")
