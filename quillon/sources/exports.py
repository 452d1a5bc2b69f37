"""History exports: a zip of CSV files, read with bad rows kept aside and folded to one row for each item."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import parse

#: The files of an export and their columns.
MEMBERS = ("ratings", "diary", "watched", "watchlist", "reviews")
FIELDS = {"Date": "date", "Name": "name", "Year": "year", "Letterboxd URI": "uri", "Rating": "rating", "Rewatch": "rewatch", "Watched Date": "watched", "Review": "review"}
RAW = "user string, source string, line long, " + ", ".join(f"{f} string" for f in FIELDS.values())


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of every zip under a path: user (the file's name), source (the member), line, and the fields as text.

    Members are found by name in any folder of the zip; missing ones give no rows. UTF-8 with or without a mark,
    bad bytes replaced, column names trimmed, empty fields null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        source = name.rsplit("/", 1)[-1].removesuffix(".csv")
                        if source in MEMBERS and name.endswith(".csv"):
                            with z.open(name) as f:
                                for line, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", "replace", newline=""))):
                                    own = {(k or "").strip(): v for k, v in row.items()}
                                    rows.append((path.rsplit("/", 1)[-1].removesuffix(".zip"), source, line, *((own.get(c) or "").strip() or None for c in FIELDS)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    return files.mapInPandas(unzip, RAW)


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): rows without an identity are kept with a reason."""
    good = rows.where("uri is not null")
    return good, rows.where("uri is null").withColumn("reason", F.lit("no uri"))


def typed(rows: DataFrame) -> DataFrame:
    """Raw rows with typed fields; what can't be read is null."""
    return rows.select("user", "source", "line", "uri", "name", parse.year(F.col("year")).alias("year"), parse.half_stars(F.col("rating")).alias("rating_half"), parse.day(F.col("date")).alias("logged"), parse.day(F.col("watched")).alias("watched"), F.coalesce(F.lower("rewatch") == "yes", F.lit(False)).alias("rewatch"), "review")


def folded(rows: DataFrame) -> DataFrame:
    """One row for each (user, uri): the latest rating, earliest dates, counts and flags over all sources, combined before the shuffle."""
    rated = F.when(F.col("rating_half").isNotNull(), F.struct(F.coalesce("watched", "logged").alias("d"), F.col("line"), F.col("rating_half").alias("r")))
    first = F.when(F.col("name").isNotNull(), F.struct("source", "line", "name", "year"))
    out = rows.groupBy("user", "uri").agg(
        F.max(rated).alias("_rated"), F.min("watched").alias("watched_at"), F.min("logged").alias("logged_at"), F.count_if(F.col("source") == "diary").alias("diary_rows"), F.bool_or("rewatch").alias("rewatch"),
        F.bool_or(F.col("source") == "watchlist").alias("on_watchlist"), F.count("review").alias("reviews"), F.min(first).alias("_first"),
    )
    return out.select("user", "uri", F.col("_first.name").alias("name"), F.col("_first.year").alias("year"), F.col("_rated.r").alias("rating_half"), "watched_at", "logged_at", "diary_rows", "rewatch", "on_watchlist", "reviews")
