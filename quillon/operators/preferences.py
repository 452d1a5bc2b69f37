"""Stated preferences of all users: what a user's own words bear out, what stands at a time, hard ones as clauses on candidates, soft ones as weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import flat

#: What a step of strength adds to a penalty, the strengths there are, and the kinds of target that each
#: clause takes: people are one kind, and a liked item or collection requires nothing.
PER_STRENGTH, STRENGTHS = 0.5, (1, 3)
CLAUSE = {"genre": "genres", "keyword": "keywords", "language": "languages", "country": "countries", "decade": "decades", "director": "people", "writer": "people", "actor": "people", "film": "ids", "collection": "ids"}


def quoted(drafts: DataFrame, messages: DataFrame) -> DataFrame:
    """The drafts (user, quote, strength and more) with `refused`: null if the strength is one there is and the quote stands in a message (user, text) of that user, white space and case aside; else the reason."""
    told = drafts.withColumn("_d", F.xxhash64(*drafts.columns)).withColumn("_q", flat(F.col("quote")))
    said = messages.select("user", flat(F.col("text")).alias("_t")).where("_t <> ''")
    cues = told.where("_q <> ''").select("user", "_d", "_q", F.split("_q", " ").alias("_w"))
    # the second of three words or more stands whole in the message, so pairs are joined by (user, word); shorter quotes
    # can begin and end within words and meet all of their user's messages
    long = cues.where("size(_w) > 2").select("user", "_d", "_q", F.col("_w")[1].alias("_w"))
    short = cues.where("size(_w) <= 2").select("user", "_d", "_q")
    spread = said.select("user", "_t", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w"))
    held = long.join(spread, ["user", "_w"]).select("user", "_d", "_q", "_t").unionByName(short.join(said, "user").select("user", "_d", "_q", "_t"))
    found = held.where(F.contains("_t", F.col("_q"))).select("user", "_d").distinct().withColumn("_ok", F.lit(True))
    why = F.when(~F.coalesce(F.col("strength").between(*STRENGTHS), F.lit(False)), "strength").when(F.col("_ok").isNull(), "not said")
    return told.join(found, ["user", "_d"], "left").select(*drafts.columns, why.alias("refused"))


def active(preferences: DataFrame, session: Column, at: Column) -> DataFrame:
    """Rows (user, scope, session, kind, target, created_at, pref_id) that stand at a time in a session: durable ones and the session's own, the last said of each user, scope, kind and target."""
    own = preferences.where((F.col("created_at") <= at) & ((F.col("scope") == "durable") | (F.col("session") == session)))
    last = F.row_number().over(Window.partitionBy("user", "scope", "kind", "target").orderBy(F.desc("created_at"), F.desc("pref_id")))
    return own.withColumn("_r", last).where("_r = 1").drop("_r")


def minutes(target: Column) -> Column:
    """The digits of a text as a number of minutes; null without any."""
    return F.nullif(F.regexp_replace(target, "[^0-9]", ""), F.lit("")).cast("int")


def failing(pool: DataFrame, bridge: DataFrame, facts: DataFrame, stated: DataFrame) -> DataFrame:
    """(user, item, clause) of candidates that a user's hard preferences keep out, one row for each clause that does.

    pool: (user, item); bridge: (kind, entity, item), collections and ids among them; facts: (item, runtime); stated: active rows with
    polarity and `hard`. Disliked targets of a kind exclude what has any; liked ones of a clause require one of them; a liked or disliked
    runtime is the longest that is taken, null runtimes stay. Joins do it all, for any number of users.
    """
    hard = stated.where("hard")
    clause = F.create_map(*(F.lit(x) for kv in CLAUSE.items() for x in kv))[F.col("kind")]
    targets = hard.where("kind <> 'runtime'").select("user", "kind", F.col("target").alias("entity"), clause.alias("clause"), "polarity").where("clause is not null")
    ids = pool.select(F.lit("film").alias("kind"), F.col("item").cast("string").alias("entity"), "item").distinct()
    met = pool.join(bridge.unionByName(ids), "item").join(targets, ["user", "kind", "entity"])
    excluded = met.where("polarity = 'dislike'").select("user", "item", F.concat(F.lit("exclude_"), "clause").alias("clause")).distinct()
    wanted = targets.where("polarity = 'like' and clause <> 'ids'").select("user", "clause").distinct()
    hit = met.where("polarity = 'like'").select("user", "item", "clause").distinct()
    required = pool.join(wanted, "user").join(hit, ["user", "item", "clause"], "left_anti").select("user", "item", F.concat(F.lit("include_"), "clause").alias("clause"))
    cap = hard.where("kind = 'runtime'").groupBy("user").agg(F.min(minutes(F.col("target"))).alias("_cap"))
    over = pool.join(cap, "user").join(facts.select("item", "runtime"), "item").where("runtime > _cap").select("user", "item", F.lit("runtime_max").alias("clause"))
    return excluded.unionByName(required).unionByName(over)


def removed(pool: DataFrame, kept_out: DataFrame) -> DataFrame:
    """(user, clause, n): what each clause alone keeps out of a user's pool, and `all` for what any does."""
    each = kept_out.groupBy("user", "clause").agg(F.count_distinct("item").alias("n"))
    return each.unionByName(kept_out.groupBy("user").agg(F.count_distinct("item").alias("n")).select("user", F.lit("all").alias("clause"), "n"))


def allowed(pool: DataFrame, kept_out: DataFrame) -> DataFrame:
    return pool.join(kept_out.select("user", "item").distinct(), ["user", "item"], "left_anti")


def weights(stated: DataFrame) -> DataFrame:
    """(user, kind, entity, weight) of soft preferences: strength times PER_STRENGTH, negative for a dislike."""
    sign = F.when(F.col("polarity") == "like", 1.0).otherwise(-1.0)
    return stated.where("not hard").select("user", "kind", F.col("target").alias("entity"), (sign * F.col("strength") * PER_STRENGTH).alias("weight"))
