import pandas as pd

from quillon.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_token_bucket_against_a_loop(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {r.id: r.admitted for r in S.drained(S.token_bucket(S.source(spark, SF, "events"), "user_id", "event_id", "ts", 0.0005, 2.0)).collect()}
    frame = events.selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 as t").toPandas().sort_values(["user_id", "t", "event_id"])
    want = {}
    for _, rows in frame.groupby("user_id"):
        tokens, last = 2.0, None
        for r in rows.itertuples():
            tokens = min(2.0, tokens + 0.0005 * (0 if last is None else r.t - last))
            last = r.t
            want[r.event_id] = tokens >= 1
            tokens -= tokens >= 1
    assert got == want and 0 < sum(want.values()) < len(want)


def test_queue_state_machine(spark, tmp_path):
    def write(n, rows):
        pd.DataFrame(rows, columns=["work", "op", "t", "id"]).to_parquet(f"{tmp_path}/{n}.parquet", index=False)

    write(1, [(1, "lease", 0.0, 1), (2, "lease", 0.0, 2), (3, "complete", 0.0, 3)])
    write(2, [(1, "lease", 50.0, 4), (2, "lease", 200.0, 5), (1, "complete", 60.0, 6)])
    stream = spark.readStream.schema("work long, op string, t double, id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}")
    got = {r.work: (r.state, r.attempts) for r in S.replayed_queue(stream, lease_s=100.0).collect()}
    assert got == {1: ("done", 1), 2: ("leased", 2), 3: ("pending", 0)}


def test_windows_equal_the_batch(spark):
    from pyspark.sql import functions as F

    typed = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = S.drained(S.window_counts(typed(S.source(spark, SF, "events")), "ts", ["event_type"], "1 day", "1 second"))
    batch = typed(spark.read.parquet(f"{SF}/events.parquet")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    last = batch.agg(F.max("start")).first()[0]
    want = sorted(tuple(r) for r in batch.where(F.col("start") < last).collect())
    assert sorted((r.start, r.event_type, r.n) for r in stream.where(F.col("start") < last).collect()) == want
