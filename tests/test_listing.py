from pyspark.sql import functions as F

from quillon.operators import filters as H
from quillon.operators import knn
from quillon.operators import listing as L
from quillon.plans import adapter as T
from quillon.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_a_narrow_filter_still_fills_the_list(spark):
    """The forty least popular items: none of them is among the channels' heads of all items."""
    seen = retrieval.seen(spark, SF).select("item")
    prices = sorted(r.popularity for r in T.items(spark, SF).join(seen, "item", "left_anti").collect())
    # the least popular unseen items lie behind every head of all items
    filters = H.HardFilters(exclude={"people": frozenset({-1})}, exclude_ids=frozenset(r.item for r in T.items(spark, SF).collect() if r.popularity > prices[min(39, len(prices) - 1)]))
    allowed = {r.item for r in H.allowed(T.items(spark, SF), filters, retrieval.bridges(spark, SF), retrieval.seen(spark, SF)).collect()}
    got = [r.item for r in retrieval.recommend(spark, SF, filters).collect()]
    assert len(got) == min(10, len(allowed)) and set(got) <= allowed


def test_queries_in_blocks(spark, monkeypatch):
    v = T.vectors(spark, SF).where("item < 60").select("item", "v")
    q = v.select(F.col("item").alias("query"), F.col("v").alias("q"))
    whole = sorted(map(tuple, knn.nearest(v, q, 3, exclude_self=True).collect()))
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    assert sorted(map(tuple, knn.nearest(v, q, 3, exclude_self=True).collect())) == whole and len(whole) == 180


def test_cutoff_keeps_undated_rows_only_without_one(spark):
    rows = spark.createDataFrame([(1, "1998-01-01"), (2, None), (3, "1999-01-01")], "item long, day string").withColumn("day", F.to_date("day"))
    assert [r.item for r in L.before(rows, "day", "1999-01-01").collect()] == [1]
    assert L.before(rows, "day", None).count() == 3


def test_bands_windows_and_points(spark):
    row = spark.range(1).select(L.band(F.lit(9.0), 2, 3.5, 0.6, 0.9).alias("a"), L.band(F.lit(None).cast("double"), 2, 3.5, 0.6, 0.9).alias("b"), L.year_proximity(L.year_drift(F.array().cast("array<int>"), F.lit(1990))).alias("c"), L.vote_weight(F.lit(10**9)).alias("d"), L.borda(F.lit(0), F.lit(1)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (0.9, 0.6, 0.5, 1.0, 1.0)
    sizes = spark.createDataFrame([(1,), (20,), (21,), (45,)], "n long")
    got = {}
    for r in L.windows(sizes, "n", 20, 10).collect():
        got.setdefault(r.n, []).append((r.first, r.stop))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1)], 20: [(0, 20)], 21: [(0, 20), (1, 21)], 45: [(0, 20), (10, 30), (20, 40), (25, 45)]}
