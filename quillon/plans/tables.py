"""Queries: sources and sinks, text, vocabulary, grounding, logs and memory, per-user models, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as X
from quillon.operators import affinity as A
from quillon.operators import logs, taste, upsert
from quillon.plans import adapter as T
from quillon.plans.registry import query
from quillon.session import table
from quillon.sources import catalogue, exports
from quillon.streaming import events as S

# sources


@query("src6_payload_shred", T.SQL + " SELECT item AS id, person, CAST(ord AS INT) AS ord, role FROM credits WHERE role = 'actor' AND ord < 10 UNION ALL SELECT item, person, CAST(ord AS INT), role FROM credits WHERE role = 'director'")
def payload_shred(spark, sf):
    """Items with their people written as JSON payloads, parsed and shredded again."""
    people = T.credits(spark, sf).groupBy("item").agg(F.collect_list(F.struct(F.col("person").alias("id"), F.lit("n").alias("name"), F.col("ord"), "role")).alias("all"))
    pick = lambda roles: F.filter("all", lambda p: p["role"].isin(*roles))
    payload = F.to_json(F.struct(F.col("item").alias("id"), "title", "runtime", "popularity", F.lit(1).alias("unknown"), F.struct(pick(["actor"]).alias("cast"), pick(["director", "writer"]).alias("crew")).alias("credits")))
    parts = catalogue.shredded(catalogue.parsed(T.items(spark, sf).join(people, "item").select(payload.alias("payload"))), billed=6, jobs=("director",))
    return parts["cast"].unionByName(parts["crew"])


@query("src9_dump_top_popular", "SELECT p_partkey AS id, p_retailprice AS popularity FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0 ORDER BY popularity DESC, id LIMIT 100")
def dump_top(spark, sf):
    dump = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("original_title"), F.col("p_retailprice").alias("popularity"), (F.col("p_size") % 7 == 0).alias("adult"), F.when(F.col("p_size") % 5 == 0, True).alias("video"))
    return catalogue.most_popular(dump, 100).select("id", "popularity")


@query("src12_listing_windows", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1), l AS (
  SELECT m, n, date_trunc('quarter', m) AS q, date_trunc('year', m) AS y, sum(n) OVER (PARTITION BY date_trunc('quarter', m)) AS nq, sum(n) OVER (PARTITION BY date_trunc('year', m)) AS ny, (SELECT count(*) FROM orders) AS a FROM m)
  SELECT CAST(CAST(f AS DATE) AS VARCHAR) AS first_day, CAST(CAST(f + to_months(CAST(k AS INT)) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS last_day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN ny <= a // 7 THEN y WHEN nq <= a // 27 THEN q ELSE m END AS f, CASE WHEN ny <= a // 7 THEN 12 WHEN nq <= a // 27 THEN 3 ELSE 1 END AS k FROM
  (SELECT m, n, q, y, nq, CASE WHEN ny <= a // 27 THEN ny ELSE 1e18 END AS ny, a FROM l)) GROUP BY ALL""")
def listing_windows(spark, sf):
    o = table(spark, sf, "orders")
    most = o.count() // 27
    out = catalogue.windows(o.select(F.to_date("o_orderdate").alias("d")), "d", most)
    return out.select(F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n")


@query("src4_lenient_parsers", """SELECT event_id, CASE WHEN h BETWEEN 1 AND 10 THEN CAST(h AS INT) ELSE -1 END AS halves, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, CASE WHEN y BETWEEN 1870 AND 2100 THEN CAST(y AS INT) ELSE -1 END AS year
  FROM (SELECT *, round_even(CAST(event_id % 60 AS DOUBLE) / 10 * 2, 0) AS h, 1800 + event_id % 400 AS y FROM events)""")
def parsers(spark, sf):
    from quillon.functions import parse

    e = table(spark, sf, "events")
    texts = e.select("event_id", F.format_string(" %.1f ", (F.col("event_id") % 60) / 10).alias("r"), F.when(F.col("user_id") % 4 == 0, "2020-13-45").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T10:00:00Z"))).alias("d"), (1800 + F.col("event_id") % 400).cast("string").alias("y"))
    return texts.select("event_id", F.coalesce(parse.half_stars(F.col("r")), F.lit(-1)).alias("halves"), parse.day(F.col("d")).cast("string").alias("day"), F.coalesce(parse.year(F.col("y")), F.lit(-1)).alias("year"))


@query("ag9_export_fold", T.SQL + """ SELECT CAST(customer AS VARCHAR) AS user, CAST(item AS VARCHAR) AS uri, arg_max(rating_half, (watched_at, o * 8 + l, rating_half)) AS rating_half, CAST(min(watched_at) FILTER (l % 2 = 0) AS VARCHAR) AS watched_at, CAST(min(watched_at) AS VARCHAR) AS logged_at,
  count(*) FILTER (l % 2 = 0) AS diary_rows, bool_or(l = 7) AS rewatch FROM watches GROUP BY ALL""")
def export_fold(spark, sf):
    """Watches written as rows of two export files, typed and folded."""
    w = T.watches(spark, sf, "customer")
    raw = w.select(
        F.col("user").cast("string").alias("user"), F.when(F.col("l") % 2 == 0, "diary").otherwise("ratings").alias("source"), (F.col("o") * 8 + F.col("l")).alias("line"), F.col("watched_at").cast("string").alias("date"), F.lit("n").alias("name"), F.lit("1999").alias("year"),
        F.col("item").cast("string").alias("uri"), F.format_string("%.1f", F.col("rating_half") / 2).alias("rating"), F.when(F.col("l") == 7, "Yes").alias("rewatch"), F.when(F.col("l") % 2 == 0, F.col("watched_at").cast("string")).alias("watched"), F.lit(None).cast("string").alias("review"),
    )
    out = exports.folded(exports.typed(exports.parted(raw)[0]))
    return out.select("user", "uri", "rating_half", F.col("watched_at").cast("string").alias("watched_at"), F.col("logged_at").cast("string").alias("logged_at"), "diary_rows", "rewatch")


# sinks


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Events as the newest row of each (user, type) before and after the middle id."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    mid = e.agg(F.expr("max(event_id) div 2").alias("mid"))
    e = e.crossJoin(F.broadcast(mid))
    newest = lambda d: logs.latest(d.drop("mid"), ["user_id", "event_type"], "event_id")
    return newest(e.where("event_id <= mid")), newest(e.where("event_id > mid"))


@query("snk1_upsert_latest", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_latest(spark, sf):
    old, new = halves(spark, sf)
    return upsert.latest_wins(old, new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("snk2_frozen_first_value", "WITH m AS (SELECT max(event_id) // 2 AS mid FROM events), h AS (SELECT user_id, event_type, event_id <= mid AS old, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events, m GROUP BY ALL) SELECT user_id, event_type, max(event_id) AS event_id, arg_min(value, event_id) AS value FROM h GROUP BY ALL")
def frozen(spark, sf):
    old, new = halves(spark, sf)
    return upsert.frozen_first(old, new, ["user_id", "event_type"], ["value"]).select("user_id", "event_type", "event_id", "value")


@query("snk3_insert_ignore", "WITH m AS (SELECT max(event_id) // 2 AS mid FROM events), h AS (SELECT user_id, event_type, event_id <= mid AS old, max(event_id) AS event_id FROM events, m GROUP BY ALL) SELECT user_id, event_type, min(event_id) AS event_id FROM h GROUP BY ALL")
def ignore(spark, sf):
    old, new = halves(spark, sf)
    return upsert.insert_ignore(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("snk4_replace_children", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber > 2)")
def replace_children(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey")).unionByName(old.where("l_orderkey % 3 = 0").select("l_orderkey"))
    return upsert.replace_children(old, old.where("l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1), parents, "l_orderkey")


@query("snk5_dimension_stubs", "SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title FROM part WHERE p_partkey % 2 = 0 OR p_partkey IN (SELECT l_partkey FROM lineitem)")
def stubs(spark, sf):
    d = T.items(spark, sf).select("item", "title").where("item % 2 = 0")
    return upsert.with_stubs(d, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item")), "item")


@query("snk6_changed_documents", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 5 IN (0, 1)")
def changed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    stored = d.where("doc_id % 5 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("sha")))
    return upsert.changed(d, stored, ["doc_id"])


@query("snk8_retention", "SELECT (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS parents, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS children")
def retention(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    p, c = upsert.retained(o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), "k", "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz"))
    return p.agg(F.count("*").alias("parents")).crossJoin(c.agg(F.count("*").alias("children")))


# text, vocabulary, grounding

NORMAL = "trim(regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("sc10_hooks", "SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE regexp_replace(left(s, 180), '\\s+\\S*$', '') END AS hook FROM (SELECT doc_id, coalesce(regexp_extract(trim(text, E' \\t\\n\\r'), '^(?s:.*?[.!?])\\s', 0), '') AS m, trim(text) AS t, CASE WHEN regexp_matches(trim(text), '[.!?]\\s') THEN regexp_extract(trim(text), '^((?s:.*?)[.!?])\\s', 1) ELSE trim(text) END AS s FROM documents)")
def hooks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.hook(F.col("text")).alias("hook"))


@query("sc8_title_leaks", f"SELECT item_id, count(*) AS n FROM (SELECT item_id, doc_id FROM (SELECT doc_id, ' ' || {NORMAL.format('text')} || ' ' AS t FROM documents), (SELECT item_id, ' ' || regexp_replace({NORMAL.format('text')}, '^(the|a|an|le|la|les|un|une|der|die|das|el|los|las|il|lo) (.)', '\\2') || ' ' AS needle FROM benchmark) WHERE contains(t, needle)) GROUP BY 1")
def leaks(spark, sf):
    """How many documents hold each item's title."""
    b = table(spark, sf, "benchmark").select("item_id", X.normal_title(F.col("text")).alias("needle"))
    d = table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace(F.translate(F.lower("text"), X.MARKED, X.PLAIN), r"[^\p{L}\p{N}]+", " ")).alias("t"))
    return title_leaks(d, b)


def title_leaks(docs: DataFrame, needles: DataFrame, most: int = 8) -> DataFrame:
    """(item_id, n): documents (doc_id, t) that hold an item's needle as whole words. A needle's first words, `most` at most, are
    looked up among the documents' runs of as many words; what they lead to is compared whole."""
    b = needles.where("needle is not null").groupBy("item_id", "needle").agg(F.count("*").alias("m")).withColumn("w", F.split("needle", " "))
    b = b.withColumn("k", F.least(F.size("w"), F.lit(most))).withColumn("key", F.xxhash64(F.expr("array_join(slice(w, 1, k), ' ')"))).drop("w")
    lengths = sorted(r.k for r in b.select("k").distinct().collect())
    d = docs.where("t is not null").withColumn("h", F.xxhash64("t"))
    words = d.select("doc_id", "h", F.split("t", " ").alias("w"))
    runs = [F.expr(f"if(size(w) >= {k}, transform(sequence(1, greatest(1, size(w) - {k - 1})), i -> xxhash64(array_join(slice(w, i, {k}), ' '))), cast(array() as array<bigint>))") for k in lengths]
    keys = words.select("doc_id", "h", F.explode(F.array_distinct(F.concat(*runs)) if runs else F.expr("cast(array() as array<bigint>)")).alias("key"))
    pairs = keys.join(b, "key").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "item_id", "needle", "m").distinct()
    held = pairs.join(d, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))
    space = F.lit(" ")
    return held.where(F.contains(F.concat(space, "t", space), F.concat(space, "needle", space))).groupBy("item_id").agg(F.sum("m").alias("n"))


@query("sc12_item_documents", T.SQL + " SELECT item, title || ' (' || genre || ')' || E'\\n' || coalesce('With ' || people || '.' || E'\\n', '') || 'Runs ' || runtime || ' minutes.' AS doc, substr(sha256(title || ' (' || genre || ')' || E'\\n' || coalesce('With ' || people || '.' || E'\\n', '') || 'Runs ' || runtime || ' minutes.'), 1, 16) AS sha FROM items LEFT JOIN (SELECT item, string_agg(person, ', ' ORDER BY ord) AS people FROM credits WHERE role = 'actor' GROUP BY 1) USING (item)")
def item_documents(spark, sf):
    people = T.credits(spark, sf).where("role = 'actor'").groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "person"))), lambda p: p["person"].cast("string")), ", ").alias("people"))
    doc = F.concat_ws("\n", F.concat("title", F.lit(" ("), "genre", F.lit(")")), F.when(F.col("people").isNotNull(), F.concat(F.lit("With "), "people", F.lit("."))), F.concat(F.lit("Runs "), F.col("runtime").cast("string"), F.lit(" minutes.")))
    return T.items(spark, sf).join(people, "item", "left").select("item", doc.alias("doc")).withColumn("sha", X.short_hash(F.col("doc")))


@query("vc1_vocabulary", T.SQL + """, v AS (SELECT 'genre' AS kind, genre AS name, item FROM items UNION ALL SELECT 'collection', collection, item FROM items UNION ALL SELECT 'keyword', keyword, item FROM keywords UNION ALL SELECT 'country', n_name, item FROM countries JOIN nation ON country = n_nationkey), c AS (SELECT kind, name, count(DISTINCT item) AS items FROM v GROUP BY ALL)
  SELECT asked, kind, name, items, confidence FROM (SELECT asked, kind, name, items, CASE WHEN lower(name) = asked THEN 1.0 ELSE 0.55 END AS confidence, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN lower(name) = asked THEN 0 ELSE 1 END, items DESC, kind, name) AS r FROM c, (VALUES ('red'), ('brand'), ('nation_1'), ('economy')) q(asked) WHERE contains(lower(name), asked)) WHERE r <= 3""")
def vocabulary(spark, sf):
    i = T.items(spark, sf)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("name"))
    parts = [i.select(F.lit("genre").alias("kind"), F.col("genre").alias("name"), "item"), i.select(F.lit("collection").alias("kind"), F.col("collection").alias("name"), "item"), T.keywords(spark, sf).select(F.lit("keyword").alias("kind"), F.col("keyword").alias("name"), "item"), T.countries(spark, sf).join(names, "country").select(F.lit("country").alias("kind"), "name", "item")]
    v = parts[0]
    for p in parts[1:]:
        v = v.unionByName(p)
    counts = v.groupBy("kind", "name").agg(F.count_distinct("item").alias("items"))
    asked = counts.withColumn("asked", F.explode(F.array(*map(F.lit, ("red", "brand", "nation_1", "economy"))))).where(F.contains(F.lower("name"), F.col("asked")))
    exact = F.lower("name") == F.col("asked")
    w = Window.partitionBy("asked").orderBy(F.when(exact, 0).otherwise(1), F.desc("items"), "kind", "name")
    return asked.withColumn("confidence", F.when(exact, F.lit(1.0)).otherwise(F.lit(0.55))).withColumn("r", F.row_number().over(w)).where("r <= 3").select("asked", "kind", "name", "items", "confidence")


@query("gr2_grounding_overlap", r"""WITH c AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda s: s <> '')) AS w, text FROM conversations WHERE role = 'assistant'), n AS (SELECT conv_id, turn, count(*) AS words, count(DISTINCT lower(w)) AS kinds, count(*) FILTER (regexp_matches(w, '[0-9]')) AS numbers FROM c GROUP BY ALL),
  u AS (SELECT DISTINCT conv_id, lower(w) AS w FROM (SELECT conv_id, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda s: s <> '')) AS w FROM conversations WHERE role = 'user')), o AS (SELECT conv_id, turn, count(*) AS held FROM (SELECT DISTINCT conv_id, turn, lower(w) AS w FROM c) JOIN u USING (conv_id, w) GROUP BY ALL)
  SELECT conv_id, turn, kinds, numbers, coalesce(held, 0) AS held, coalesce(held, 0) >= 0.6 * kinds AS grounded FROM n LEFT JOIN o USING (conv_id, turn)""")
def grounding(spark, sf):
    """Of each answer, the distinct words that the user's turns hold, and whether these are three in five."""
    c = table(spark, sf, "conversations")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    said = c.where("role = 'user'").select("conv_id", F.explode(words).alias("w")).select("conv_id", F.lower("w").alias("w")).distinct()
    own = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(words).alias("raw")).withColumn("w", F.lower("raw"))
    met = said.withColumn("held", F.lit(1))
    each = own.groupBy("conv_id", "turn", "w").agg(F.count_if(F.col("raw").rlike("[0-9]")).alias("num")).join(met, ["conv_id", "w"], "left")
    out = each.groupBy("conv_id", "turn").agg(F.count("*").alias("kinds"), F.sum("num").alias("numbers"), F.count("held").alias("held"))
    return out.withColumn("grounded", F.col("held") >= 0.6 * F.col("kinds"))


# logs and memory


@query("tm14_preferences_as_of", "SELECT event_id, user_id, event_type, value FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events), (SELECT quantile_disc(ts, 0.5) AS mid FROM events) WHERE ts <= mid AND (e IS NULL OR e > mid)")
def as_of(spark, sf):
    e = table(spark, sf, "events")
    at = e.agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(cast(ts as timestamp)))").alias("at"))
    valid = logs.validity(e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id", "event_type"], "t", "event_id").crossJoin(F.broadcast(at))
    return logs.as_of(valid, "t", F.col("at")).select("event_id", "user_id", "event_type", "value")


@query("wn8_transcript_budget", "SELECT conv_id, turn, cost, used FROM (SELECT conv_id, turn, cost, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used, max(turn) OVER (PARTITION BY conv_id) AS last FROM (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + 4 AS cost FROM conversations)) WHERE used <= 400 OR turn = last")
def transcript(spark, sf):
    return logs.within_budget(table(spark, sf, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn", "cost", "used")


@query("wn9_next_sequence", "SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY 1")
def next_sequence(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))


@query("ss15_error_streaks", "WITH g AS (SELECT user_id, value < 20 AS bad, sum(CASE WHEN coalesce(value < 20, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, max(n) AS longest FROM (SELECT user_id, i, count(*) FILTER (bad) AS n FROM g GROUP BY ALL) GROUP BY 1")
def streaks(spark, sf):
    return logs.streaks(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.coalesce(F.col("value") < 20, F.lit(False)))


@query("ss10_repeated_calls", "SELECT user_id, event_type, substr(sha256(props), 1, 16) AS print, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def repeated(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type", X.short_hash(F.col("props")).alias("print")).agg(F.count("*").alias("n")).where("n >= 2")


@query("ag6_cost_rollup", "WITH r AS (SELECT event_type AS k, avg(value) AS rate FROM events WHERE event_type < 'm' GROUP BY 1), a AS (SELECT coalesce(rate, 0.5) AS rate, event_type, value, user_id % 3 = 0 AS unknown FROM events LEFT JOIN r ON k = event_type) SELECT event_type, count(*) AS n, count(*) FILTER (unknown) AS unknown, round(sum(CASE WHEN unknown THEN NULL ELSE value * rate END), 4) AS cost FROM a GROUP BY 1")
def costs(spark, sf):
    e = table(spark, sf, "events")
    rates = e.where("event_type < 'm'").groupBy("event_type").agg(F.avg("value").alias("rate")).unionByName(spark.range(1).select(F.lit("*").alias("event_type"), F.lit(0.5).alias("rate")))
    called = logs.rated(e, rates, "event_type", "rate").withColumn("unknown", F.col("user_id") % 3 == 0)
    return called.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("unknown").alias("unknown"), F.round(F.sum(F.when(~F.col("unknown"), F.col("value") * F.col("rate"))), 4).alias("cost"))


@query("jn20_span_depths", "WITH RECURSIVE t AS (SELECT event_id, 0 AS depth FROM events WHERE event_id < 3 UNION ALL SELECT e.event_id, depth + 1 FROM events e JOIN t ON e.event_id >= 3 AND e.event_id // 3 = t.event_id) SELECT event_id, depth FROM t")
def depths(spark, sf):
    from quillon.storage import shared_dir

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") >= 3, F.expr("event_id div 3")).alias("parent"))
    return logs.depths(e, "event_id", "parent")


@query("wn15_latency_share", "SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def share(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / F.max("value").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("sc25_json_props", "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (CAST(props->>'k' AS BIGINT) > 50) AS high FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k > 50).alias("high"))


# per-user models


def rated(spark, sf) -> DataFrame:
    return A.signals(T.history(spark, sf)).join(T.vectors(spark, sf).select("item", "v"), "item").select("user", "item", "z", "mass", "v")


@query("tm7_taste_modes")
def modes(spark, sf):
    return taste.modes(rated(spark, sf))


@query("tm1_calibrated_signals")
def calibrated(spark, sf):
    """Signals of each nation's history against a generic viewer, whose facts come from all customers."""
    facts = A.vote_quality(T.history(spark, sf, "customer")).select("item", "mean", "votes")
    items = T.items(spark, sf).select("item", F.expr("runtime div 10").alias("decade"), "genre")
    rows = T.history(spark, sf).select("user", "item", (F.col("rating_half") / 2.0).alias("stars")).join(items, "item", "left").join(facts, "item", "left")
    return taste.calibrated(rows)


# streams


def typed_events(spark, sf) -> DataFrame:
    return S.source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ss4_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, sf):
    return S.drained(S.first_of_key(typed_events(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"]))


@query("ss6_stream_queue")
def queue(spark, sf):
    ops = typed_events(spark, sf).select((F.col("user_id") % 97).alias("work"), F.element_at(F.array(*map(F.lit, ("lease", "complete", "fail", "lease", "requeue"))), (F.col("event_id") % 5 + 1).cast("int")).alias("op"), (F.unix_micros("ts") / 1e6).alias("t"), F.col("event_id").alias("id"))
    return S.replayed_queue(ops)


@query("ss5_stream_token_bucket")
def bucket(spark, sf):
    return S.drained(S.token_bucket(typed_events(spark, sf), "user_id", "event_id", "ts"))
