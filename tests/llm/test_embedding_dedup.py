import numpy as np

from quillon.llm import embedding_dedup as ed


def brute(rows, threshold):
    ok, unit = [], []
    for v in rows:
        a = None if not v or None in v else np.array(v, np.float64)
        ok.append(a is not None and np.isfinite(a).all() and a.any())
        unit.append(a / np.linalg.norm(a) if ok[-1] else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in link[i])]) for i in range(n)]
    return [(i, len(link[i]), label[i], label[i] == i) for i in range(n)]


def data(seed, n=260, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.28 * rng.normal(size=(n, d))).astype(np.float32)
    x[5] = x[4]
    x[200:230] = x[100]
    x[30] *= 7
    rows = [v.tolist() for v in x]
    rows[7], rows[8], rows[9], rows[10], rows[11] = None, [0.0] * d, [float("nan")] * d, [1.0] * (d - 1) + [None], []
    rows[12], rows[13] = [1.0, 2.0], [2.0, 4.0]
    rows[14] = [float("inf")] + [1.0] * (d - 1)
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    for seed, kind in ((1, "float"), (2, "double")):
        rows = data(seed)
        vectors = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>, kept string").repartition(3)
        got = sorted(map(tuple, ed.near_duplicates(vectors, 0.9).collect()))
        assert got == brute(rows, 0.9)


def test_repeats_and_empty_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.near_duplicates(vectors).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert ed.near_duplicates(vectors.limit(0)).count() == 0
    assert ed.near_duplicates(vectors.where("vec_id = 1").selectExpr("vec_id", "cast(null as array<float>) as embedding")).count() == 2


def test_null_ids_link(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (5, [0.99, 0.1, 0.0]), (None, [1.0, 0.01, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 0.99, 0.02]), (7, [0.0, 0.0, 1.0]), (8, [0.0, 0.02, 1.0]), (None, None)]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = [(5, 2, 5, True), (None, 2, 5, False), (None, 2, 5, False), *[(None, 2, None, True)] * 3, (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True)]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)
