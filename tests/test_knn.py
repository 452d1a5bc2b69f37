"""Nearest neighbours by products of matrices against all pairs, with ties, odd vectors and several batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.vectors import dot, unit
from quillon.operators import knn, ranking


def plain(vectors, queries, k, exclude_self):
    pairs = vectors.select("item", unit(F.col("v")).alias("v")).crossJoin(queries.select("query", unit(F.col("q")).alias("q")))
    pairs = pairs.where("item <> query") if exclude_self else pairs
    return ranking.ranked(pairs.select("query", "item", dot(F.col("v"), F.col("q")).alias("score")), k, groups=["query"])


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(knn, "ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 7)).round(1)
    x[20:90] = x[3]  # more copies than places
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 7), (301, None), (302, [1.0] * 3), (303, [1.0] * 6 + [None]), (304, []), (None, x[5].tolist())]
    vectors = spark.createDataFrame(rows, "item long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i % 9 == 3] + [(300, [0.0] * 7), (301, None), (302, [2.0, 1.0, 0.0])], "query long, q array<double>")
    key = lambda df: sorted(map(str, df.select("query", "item", "score", "rank").collect()))
    found = knn.nearest(vectors, queries, 5, exclude_self=exclude_self)
    assert key(found) == key(plain(vectors, queries, 5, exclude_self))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert knn.nearest(vectors, queries.limit(0), 5).count() == 0 == knn.nearest(vectors.limit(0), queries, 5).count()
