"""Nested catalogue payloads, id dumps and the planning of paged listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = "struct<id:long,name:string,ord:int,role:string>"
PAYLOAD = f"id long, title string, runtime int, release_date string, popularity double, genres array<struct<id:long,name:string>>, credits struct<cast:array<{PERSON}>,crew:array<{PERSON}>>, releases array<struct<country:string,dates:array<string>>>"
DUMP = "id long, original_title string, popularity double, adult boolean, video boolean"


def parsed(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Typed records of JSON texts; unknown fields are ignored, a text that is no JSON gives nulls."""
    return raw.withColumn("r", F.from_json(F.col(column), PAYLOAD)).select(*(c for c in raw.columns if c != column), "r.*")


def shredded(records: DataFrame, billed: int = 30, jobs: tuple[str, ...] = ("director", "writer")) -> dict[str, DataFrame]:
    """The item table and its bridges: genres, cast in order of billing (cut), crew of the jobs kept."""
    cast = F.slice(F.array_sort(F.filter("credits.cast", lambda p: p["id"].isNotNull()), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)), 1, billed)
    crew = F.filter("credits.crew", lambda p: p["role"].isin(*jobs))
    people = lambda a: F.explode(a).alias("p")
    fields = [F.col("p.id").alias("person"), F.col("p.ord").alias("ord"), F.col("p.role").alias("role")]
    return {
        "items": records.select("id", "title", "runtime", "popularity", release_years(F.col("releases")).alias("years")),
        "genres": records.select("id", F.explode("genres").alias("g")).select("id", F.col("g.id").alias("genre"), F.col("g.name").alias("name")),
        "cast": records.select("id", people(cast)).select("id", *fields),
        "crew": records.select("id", people(crew)).select("id", *fields),
    }


def release_years(releases):
    """Distinct years of nested release dates, ascending."""
    dates = F.flatten(F.transform(F.coalesce(releases, F.array()), lambda r: F.coalesce(r["dates"], F.array())))
    return F.sort_array(F.array_distinct(F.filter(F.transform(dates, lambda d: F.expr("try_cast(null as int)") if d is None else F.year(F.try_to_date(F.substring(d, 1, 10), "yyyy-MM-dd"))), lambda y: y.isNotNull())))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A gzipped dump of one JSON object a line; a bad line fails."""
    return spark.read.schema(DUMP).option("mode", "FAILFAST").json(path)


def most_popular(dump: DataFrame, n: int) -> DataFrame:
    return dump.where(~F.coalesce("adult", F.lit(False)) & ~F.coalesce("video", F.lit(False))).orderBy(F.desc("popularity"), "id").limit(n)


def latest_day(at):
    """The newest day whose dump is out at a time: it is published at 08:00 UTC."""
    return F.when(F.hour(at) >= 8, F.to_date(at)).otherwise(F.date_sub(F.to_date(at), 1))


def windows(dated: DataFrame, day: str, most: int) -> DataFrame:
    """(first_day, last_day, n): each year whole, in quarters or in months, so that no window holds more than `most` rows where that can be."""
    months = dated.groupBy(F.trunc(day, "month").alias("m")).agg(F.count("*").alias("n"))
    levels = months.withColumn("q", F.trunc("m", "quarter")).withColumn("y", F.trunc("m", "year"))
    by = {k: levels.groupBy(k).agg(F.sum("n").alias(f"n_{k}")) for k in ("y", "q")}
    told = levels.join(by["q"], "q").join(by["y"], "y")
    level = F.when(F.col("n_y") <= most, "y").when(F.col("n_q") <= most, "q").otherwise("m")
    first = F.when(level == "y", F.col("y")).when(level == "q", F.col("q")).otherwise(F.col("m"))
    length = F.when(level == "y", 12).when(level == "q", 3).otherwise(1)
    return told.select(first.alias("first_day"), F.date_sub(F.add_months(first, length), 1).alias("last_day"), "n").groupBy("first_day", "last_day").agg(F.sum("n").alias("n"))
