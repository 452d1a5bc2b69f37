"""Queries: runs of arms over the pools of every fold, names that are close to what was asked, cached reads that a write made stale."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normal_title
from quillon.operators import asof, fuzzy, runs
from quillon.operators import evaluation as E
from quillon.plans import adapter as T
from quillon.plans import learning as L
from quillon.plans.recommend import BETA
from quillon.plans.registry import query
from quillon.plans.retrieval import NORMAL
from quillon.session import table
from quillon.storage import shared_dir

#: Ten arms; each masks features of the prior or has weights of its own.
ARMS = {
    "prior": {"weights": BETA},
    "no_modes": {"weights": BETA, "zeroed": ["mode_affinity", "mode_margin", "anti_affinity"]},
    "no_ridge": {"weights": BETA, "zeroed": ["ridge_pref", "ridge_leverage"]},
    "no_people": {"weights": BETA, "zeroed": ["director_aff", "writer_aff", "actor_aff"]},
    "no_keywords": {"weights": BETA, "zeroed": ["keyword_aff"]},
    "no_query": {"weights": BETA, "zeroed": ["query_sim", "bm25"]},
    "no_penalties": {"weights": BETA, "zeroed": ["country_penalty", "soft_pref_penalty"]},
    "crowd": {"weights": {"popularity": 0.5, "vote_quality": 0.5}},
    "people": {"weights": {"director_aff": 0.5, "writer_aff": 0.25, "actor_aff": 0.25}},
    "modes": {"weights": {"mode_affinity": 0.6, "mode_margin": 0.4}},
}


def results(spark, sf) -> runs.Results:
    """All arms over all folds: the first half of the arms was stored before, and the second call runs the rest; a third has nothing to do."""
    _, val, pool, scaled = L.values(spark, sf)
    judged = val.select("user", "item", E.relevance(F.col("rating_half")).alias("rel"))
    told = runs.arms(spark, ARMS)
    out = runs.Results(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")
    out.run(told.where("arm < 'no_p'"), pool, scaled, judged)
    out.run(told, pool, scaled, judged)
    return out


VALUES = "(VALUES " + ", ".join(f"('{a}', '{f}', {w!r})" for a, c in ARMS.items() for f, w in c["weights"].items() if f not in c.get("zeroed", [])) + ") w(arm, feature, weight)"
NAMES = "(VALUES " + ", ".join(f"('{a}')" for a in ARMS) + ") n(arm)"
RUNS = L.PROFILE + f""", judged AS (SELECT user, item, CASE WHEN rating_half >= 9 THEN 3 WHEN rating_half = 8 THEN 2 WHEN rating_half = 7 THEN 1 ELSE 0 END AS rel FROM val
), ranked AS MATERIALIZED (SELECT arm, user, item, row_number() OVER (PARTITION BY arm, user ORDER BY score DESC, item) AS rank FROM (SELECT arm, user, item, round(sum(coalesce(weight * scaled, 0)), 9) AS score FROM sc CROSS JOIN {NAMES} LEFT JOIN {VALUES} USING (arm, feature) GROUP BY ALL) QUALIFY rank <= 50
), ideal AS (SELECT user, sum(CASE WHEN p <= 10 THEN (pow(2, rel) - 1) / log2(p + 1) END) AS i, count(*) FILTER (rel >= 2) AS w FROM (SELECT user, rel, row_number() OVER (PARTITION BY user ORDER BY rel DESC, item) AS p FROM judged) GROUP BY 1
), got AS (SELECT arm, user, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS d, count(*) FILTER (rel >= 2) AS h, min(rank) FILTER (rel >= 1) AS f FROM ranked JOIN judged USING (user, item) GROUP BY ALL
), wide AS (SELECT arm, user, CASE WHEN i > 0 THEN coalesce(d, 0) / i ELSE 0 END AS ndcg, CASE WHEN w > 0 THEN coalesce(h, 0) / w ELSE 0 END AS recall, coalesce(1.0 / f, 0) AS mrr FROM ideal CROSS JOIN {NAMES} LEFT JOIN got USING (arm, user)
), metric AS MATERIALIZED (SELECT arm, user, 'ndcg' AS metric, ndcg AS value FROM wide UNION ALL SELECT arm, user, 'recall', recall FROM wide UNION ALL SELECT arm, user, 'mrr', mrr FROM wide)"""


@query("ev25_run_matrix", RUNS + " SELECT arm, user // 8 AS user, user % 8 AS fold, metric, round(value, 5) AS value FROM metric")
def run_matrix(spark, sf):
    """Metrics of ten arms for every user and fold."""
    return results(spark, sf).rows().select("arm", F.floor(F.col("user") / 8).alias("user"), (F.col("user") % 8).alias("fold"), "metric", F.round("value", 5).alias("value"))


@query("ev31_deltas", RUNS + " SELECT arm, metric, round(avg(d), 5) AS delta, count(*) FILTER (d > 1e-12) AS better, count(*) FILTER (d < -1e-12) AS worse FROM (SELECT m.arm, m.metric, m.user % 8 AS fold, avg(m.value - b.value) AS d FROM metric m JOIN metric b ON b.arm = 'prior' AND b.user = m.user AND b.metric = m.metric WHERE m.arm <> 'prior' GROUP BY ALL) GROUP BY ALL")
def deltas(spark, sf):
    """What each arm gains or loses against the prior, and in how many folds."""
    return runs.deltas(results(spark, sf).rows(), "prior").select("arm", "metric", F.round("delta", 5).alias("delta"), "better", "worse")


def asked_names(spark, sf) -> tuple[DataFrame, DataFrame]:
    """What is asked for, the titles of every 20th item with their last letter changed, and the distinct names with their most popular item."""
    n = T.items(spark, sf).select("item", normal_title(F.col("title")).alias("name"), "popularity")
    asked = n.where("item % 20 = 0").select(F.col("item").alias("query"), F.expr("concat(left(name, length(name) - 1), 'x')").alias("asked"))
    best = n.groupBy("name").agg(F.max(F.struct("popularity", (-F.col("item")).alias("o"))).alias("b")).select("name", F.col("b.popularity").alias("popularity"), (-F.col("b.o")).alias("item"))
    return asked, best


ASKED = f""", n AS (SELECT item, {NORMAL} AS name, popularity FROM items), q AS (SELECT item AS query, left(name, length(name) - 1) || 'x' AS asked FROM n WHERE item % 20 = 0
), d AS (SELECT DISTINCT asked, name, round(1.0 - levenshtein(asked, name) / greatest(length(asked), length(name)), 9) AS sim FROM (SELECT DISTINCT asked FROM q), (SELECT DISTINCT name FROM n))"""


@query("jn13_title_resolution", T.SQL + ASKED + " SELECT query, item, round(sim, 6) AS similarity FROM (SELECT query, n.item, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, popularity DESC, n.item) AS r FROM q JOIN d USING (asked) JOIN n USING (name) WHERE sim >= 0.6) WHERE r = 1")
def title_resolution(spark, sf):
    """The closest title of all, by similarity, popularity and id."""
    asked, best = asked_names(spark, sf)
    found = fuzzy.close(asked, best).withColumn("sim", F.round("similarity", 9)).join(best, "name")
    first = F.max(F.struct("sim", "popularity", (-F.col("item")).alias("o"))).alias("b")
    return asked.join(found, "asked").groupBy("query").agg(first).select("query", (-F.col("b.o")).alias("item"), F.round("b.sim", 6).alias("similarity"))


@query("sc30_suggestions", T.SQL + ASKED + " SELECT asked, name, round(sim, 6) AS similarity, place FROM (SELECT asked, name, sim, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, name) AS place FROM d WHERE sim >= 0.6) WHERE place <= 3")
def suggestions(spark, sf):
    """The three closest names to each string that was asked for."""
    asked, best = asked_names(spark, sf)
    return fuzzy.suggestions(asked, best).select("asked", "name", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("ss11_cache_reads", """WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click')), w AS (SELECT user_id, ts, max(event_id) AS write_id FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL), c AS (SELECT user_id, ts, max(event_id) AS read_id FROM r GROUP BY ALL)
  SELECT r.event_id, coalesce(c.read_id, -1) AS read_id, coalesce(w.write_id, -1) AS write_id, c.read_id IS NOT NULL AND (w.ts IS NULL OR w.ts < c.ts) AS hit FROM r ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.ts > w.ts ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts > c.ts""")
def cache_reads(spark, sf):
    """Whether each read finds what an earlier read of its user left, with no write since."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    reads, writes = events.where("event_type in ('view', 'click')").select("event_id", "user_id", "ts"), events.where("event_type in ('purchase', 'signup')")
    told = asof.last_before(reads, writes, ["user_id"], "ts", F.col("event_id"), 86_400, "w")
    told = asof.last_before(told, reads, ["user_id"], "ts", F.col("event_id"), 86_400, "c")
    return told.select("event_id", F.coalesce("c.value", F.lit(-1)).alias("read_id"), F.coalesce("w.value", F.lit(-1)).alias("write_id"), (F.col("c").isNotNull() & (F.col("w").isNull() | (F.col("w.time") < F.col("c.time")))).alias("hit"))
