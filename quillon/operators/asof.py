"""The last earlier row of a key, for keys of any size: time is cut into buckets, and what a bucket ends with is carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: Column, width: int, name: str = "last", inclusive: bool = False) -> DataFrame:
    """The left rows with `name`: (time, value) of the right row of their keys with the largest time before theirs, or null.

    Both sides lie in buckets of `width` seconds of a key. Within a bucket a running maximum answers; what the buckets before end
    with is one row for each, and a running maximum of these few rows goes to each bucket. So a key with half of all rows is as many
    tasks as it has buckets. Of right rows of one time the largest value counts; with `inclusive`, rows of the same time do too.
    Null keys match null keys; left rows without a time have no last row.
    """
    bucket = F.floor(F.unix_micros(time) / (width * 1_000_000))
    known = right.where(F.col(time).isNotNull()).select(*keys, bucket.alias("_b"), F.col(time).alias("_t"), F.struct(F.col(time).alias("time"), value.alias("value")).alias("_v"))
    ends = known.groupBy(*keys, "_b").agg(F.max("_v").alias("_end"))
    asked = left.withColumn("_b", bucket).withColumn("_id", F.lit(1))
    # the buckets of either side in order, each with what all before it ended with
    every = ends.unionByName(asked.select(*keys, "_b").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    order = Window.partitionBy(*keys).orderBy("_b")
    carried = every.groupBy(*keys, "_b").agg(F.max("_end").alias("_end")).withColumn("_carry", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    own = asked.select(*(F.col(c) for c in left.columns), "_b", F.col(time).alias("_t"), F.lit(None).cast(ends.schema["_end"].dataType).alias("_v"), F.lit(True).alias("_ask"))
    both = own.unionByName(known.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_b").orderBy(F.col("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if not inclusive:  # rows of the same time stand behind
        both = both.withColumn("_t", F.unix_micros("_t") * 2 + F.when(F.col("_ask"), 0).otherwise(1))
    told = both.withColumn("_in", F.max("_v").over(within)).where("_ask")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    met = told.alias("l").join(carried.alias("r"), condition, "left")
    answer = F.when(F.col(f"l.{time}").isNotNull(), F.coalesce(F.col("l._in"), F.col("r._carry")))
    return met.select(*(F.col(f"l.{c}") for c in left.columns), answer.alias(name))
