"""The fixed tables seen as items, people, users and histories.

part is the item; suppliers of its lines are its people, billed by their number of lines; nations and customers are
users, a line of their orders is a watch and its quantity the rating in half stars; embeddings are item vectors.
`SQL` holds the same views for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import table


def items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"), F.col("p_brand").alias("collection"), F.col("p_size").alias("runtime"), F.col("p_retailprice").alias("popularity"))


def credits(spark: SparkSession, sf: str) -> DataFrame:
    """(item, person, ord, role): people of an item by lines, then id; two directors, two writers, ten actors."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"))
    ordered = n.withColumn("ord", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "person")) - 1).where("ord < 14")
    role = F.when(F.col("ord") < 2, "director").when(F.col("ord") < 4, "writer").otherwise("actor")
    return ordered.select("item", "person", "ord", role.alias("role"))


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """(item, country) through the nations of its billed people."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("country"))
    return credits(spark, sf).join(s, "person").select("item", "country").distinct()


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item", F.explode(F.array_distinct(F.split(F.lower("title"), r"\s+"))).alias("keyword")).where("keyword <> ''")


def watches(spark: SparkSession, sf: str, user: str) -> DataFrame:
    """(user, item, watched_at, rating_half, o, l) of every line; user: customer or nation."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("watched_at"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("l"), (F.floor((F.col("l_quantity") - 1) / 5) + 1).cast("int").alias("rating_half"))
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey" if user == "nation" else "c_custkey").cast("long").alias("user"))
    return lines.join(orders, "o").join(who, "c").select("user", "item", "watched_at", "rating_half", "o", "l")


def history(spark: SparkSession, sf: str, user: str = "nation") -> DataFrame:
    """One row for each (user, item): the newest watch, and whether it repeats an earlier one."""
    w = watches(spark, sf, user)
    newest = F.max(F.struct("watched_at", "o", "l", "rating_half")).alias("w")
    return w.groupBy("user", "item").agg(newest, F.count("*").alias("n")).select("user", "item", F.col("w.watched_at").alias("watched_at"), F.col("w.rating_half").alias("rating_half"), (F.col("n") > 1).alias("rewatch"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), "label")


SQL = """WITH RECURSIVE items AS (
  SELECT p_partkey AS item, p_name AS title, p_type AS genre, p_brand AS collection, p_size AS runtime, p_retailprice AS popularity FROM part
), credits AS (
  SELECT item, person, ord, CASE WHEN ord < 2 THEN 'director' WHEN ord < 4 THEN 'writer' ELSE 'actor' END AS role
  FROM (SELECT l_partkey AS item, l_suppkey AS person, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) - 1 AS ord FROM lineitem GROUP BY 1, 2) WHERE ord < 14
), countries AS (
  SELECT DISTINCT item, s_nationkey AS country FROM credits JOIN supplier ON s_suppkey = person
), keywords AS (
  SELECT DISTINCT item, keyword FROM (SELECT item, unnest(string_split_regex(lower(title), '\\s+')) AS keyword FROM items) WHERE keyword <> ''
), watches AS (
  SELECT c_custkey AS customer, CAST(c_nationkey AS BIGINT) AS nation, l_partkey AS item, CAST(o_orderdate AS DATE) AS watched_at, CAST(floor((l_quantity - 1) / 5) AS INT) + 1 AS rating_half, o_orderkey AS o, l_linenumber AS l
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), hist AS (
  SELECT nation AS user, item, max(watched_at) AS watched_at, arg_max(rating_half, (watched_at, o, l, rating_half)) AS rating_half, count(*) > 1 AS rewatch FROM watches GROUP BY 1, 2
), custhist AS (
  SELECT customer AS user, item, max(watched_at) AS watched_at, arg_max(rating_half, (watched_at, o, l, rating_half)) AS rating_half, count(*) > 1 AS rewatch FROM watches GROUP BY 1, 2
), vectors AS (
  SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
)"""
