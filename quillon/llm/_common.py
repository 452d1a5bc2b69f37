"""What several operators share: the shared folder, written tables, size-checked broadcasts, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that a function is given at once (a longer row comes alone).
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch, at most: executors hold whole batches of texts outside their heap, and so do Python workers.
BATCH_ROWS = 1000
#: Rows up to this many bytes in all may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
T = TypeVar("T")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only under a local master, where it may be unset, a temporary one is made."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-quillon-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Lower the session's rows of an Arrow batch to so many; a lower setting stays."""
    rows = int(spark.conf.get(ARROW_ROWS))
    if not 0 < rows <= most:
        spark.conf.set(ARROW_ROWS, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and written to the shared folder: later reads don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast only if its counted rows are under the limit. df should be cheap to count, as a written table is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


_KEPT: dict = {}


def give_back() -> None:
    """Give freed memory, Arrow's and (where the C library can) the interpreter's, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(make: Callable[[], T], *key: object) -> T:
    """What a Python worker keeps between batches: one object, as workers are used again and another stage's shouldn't stay beside it."""
    if _KEPT.get("key") != key:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT["value"] = make()
        _KEPT["key"] = key
    return _KEPT["value"]


def release() -> None:
    """Drop what another stage's tasks kept in this worker, and give freed memory back to the machine."""
    if _KEPT:
        _KEPT.clear()
        give_back()
    else:
        pa.default_memory_pool().release_unused()


def cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), most)
        yield from cut(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with a function of one batch of bounded rows and bytes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, size):
                out = function(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    small_batches(df.sparkSession, rows)
    return df.mapInArrow(over, schema)


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregation and an equi-join, and writes each
    round's edges to the shared folder. No node's neighbours are ever collected.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    pairs = written(pairs, name)
    for _ in range(most_rounds):
        # done when every node that has a smaller one has just one, which itself has none
        ends = pairs.select(F.col("hi").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(pairs.select(F.col("lo").alias("n"), F.lit(0).alias("h"), F.lit(1).alias("l")))
        if ends.groupBy("n").agg(F.sum("h").alias("h"), F.max("l").alias("l")).where("h > 1 or h > 0 and l > 0").isEmpty():
            break
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(least, "hi")
        small_star = linked.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), "hi"))
        pairs = written(small_star.where("hi <> lo").distinct(), name)
    else:
        raise RuntimeError("the components did not settle")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
