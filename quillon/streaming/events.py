"""Streams over an event table: deduplication, windows, a leased work queue and a token bucket.

Each function takes a streaming DataFrame; `drained` runs one to the end of its input and returns what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.storage import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 4) -> DataFrame:
    """A table replayed as a stream, some files at a time."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch)
    if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):  # one file: streams read folders
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input with exactly-once file output, and read it back."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def first_of_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent enqueue: the first event of each key."""
    return events.dropDuplicates(keys)


def window_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "3650 days") -> DataFrame:
    """(window start, keys, n, total) of tumbling windows; a window is final when the watermark has passed it."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
    )


BUCKET = "key long, id long, admitted boolean, tokens double"


def token_bucket(events: DataFrame, key: str, id_: str, time: str, rate: float = 0.001, burst: float = 5.0) -> DataFrame:
    """Whether each event finds a token in its key's bucket, which refills at `rate` a second up to `burst`. State: (tokens, last time)."""

    def admit(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        out = []
        for t, i in zip(rows["t"], rows["id"], strict=True):
            if last is not None:
                tokens = min(burst, tokens + rate * max(0.0, t - last))
            last = t if last is None else max(last, t)
            ok = tokens >= 1
            tokens -= ok
            out.append((int(k[0]), int(i), bool(ok), float(tokens)))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame(out, columns=["key", "id", "admitted", "tokens"])

    slim = events.select(F.col(key).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("t")).withColumn("t", F.col("t") / 1e6)
    return slim.groupBy("key").applyInPandasWithState(admit, BUCKET, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


LEASES = "work long, state string, attempts int, lease_until double"


def queue(operations: DataFrame, lease_s: float = 3600.0, most: int = 5) -> DataFrame:
    """The state of each work item after its operations (work, op, t, id): lease, complete, fail, requeue.

    A lease is granted while the item is free or its last lease has run out; `most` failures kill it. Emits the
    new state for each micro-batch; the last row by attempts and time is the item's state.
    """

    def step(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        at, attempts, until = state.get if state.exists else ("pending", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        for t, op in zip(rows["t"], rows["op"], strict=True):
            if op == "lease" and (at == "pending" and t >= until or at == "leased" and t >= until):
                at, attempts, until = "leased", attempts + 1, t + lease_s
            elif op == "complete" and at == "leased":
                at = "done"
            elif op == "fail" and at == "leased":
                at, until = ("dead", until) if attempts >= most else ("pending", t + min(300.0, 2.0 * 2 ** (attempts - 1)))
            elif op == "requeue" and at == "leased":
                at, attempts, until = "pending", max(0, attempts - 1), t
        state.update((at, int(attempts), float(until)))
        yield pd.DataFrame([(int(k[0]), at, int(attempts), float(until))], columns=["work", "state", "attempts", "lease_until"])

    return operations.groupBy("work").applyInPandasWithState(step, LEASES, "at string, attempts int, until double", "update", GroupStateTimeout.NoTimeout)


def replayed_queue(operations: DataFrame, lease_s: float = 3600.0, most: int = 5) -> DataFrame:
    """`queue` run to the end of its input; one row for each work item, the newest of those that the batches wrote."""
    spark = operations.sparkSession
    out = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    (queue(operations, lease_s, most).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(LEASES + ", batch long").parquet(f"{out}/rows")
    best = rows.groupBy("work").agg(F.max(F.struct("batch", "state", "attempts", "lease_until")).alias("b"))
    return best.select("work", "b.state", "b.attempts", "b.lease_until")
