import zipfile

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import parse, text
from quillon.operators import evaluation, filters, logs, quantiles, ranking, taste, upsert
from quillon.sources import catalogue, exports

SETS = st.dictionaries(st.sampled_from(["genres", "keywords"]), st.frozensets(st.sampled_from("abcd"), max_size=3), max_size=2)
FILTERS = st.builds(filters.HardFilters, runtime_min=st.none() | st.integers(0, 50), runtime_max=st.none() | st.integers(0, 50), include=SETS, exclude=SETS, exclude_ids=st.frozensets(st.integers(0, 5), max_size=3), exclude_watched=st.booleans())


def passes(f, item):
    bounds = (f.runtime_min is None or item["runtime"] >= f.runtime_min) and (f.runtime_max is None or item["runtime"] <= f.runtime_max)
    sets = all(item[k] & v for k, v in f.include.items()) and not any(item[k] & v for k, v in f.exclude.items())
    return bounds and sets and item["id"] not in f.exclude_ids and not (f.exclude_watched and item["watched"])


ITEMS = st.fixed_dictionaries({"id": st.integers(0, 5), "runtime": st.integers(0, 50), "watched": st.booleans(), "genres": st.frozensets(st.sampled_from("abcd"), min_size=1, max_size=1), "keywords": st.frozensets(st.sampled_from("abcd"), max_size=3)})


@settings(max_examples=200, deadline=None)
@given(FILTERS, FILTERS, FILTERS, ITEMS)
def test_merge_never_loosens(a, b, c, item):
    assert a.merge(a) == a.merge(a).merge(a)
    assert a.merge(b).merge(c) == a.merge(b.merge(c))
    if passes(a.merge(b), item):
        assert passes(b, item) and all(passes(a, item) for _ in [0])


def test_parsers_and_text(spark):
    rows = [("3.5", "2020-02-29T10:00", "1999", "The Élan, again!"), ("0.25", "2020-02-30", "99", "le"), ("abc", None, "x", None), (" 5 ", "2020-01-01", "2101", "An A"), ("5.5", "", "", "")]
    d = spark.createDataFrame(rows, "r string, d string, y string, t string")
    out = d.select(parse.half_stars(F.col("r")), parse.day(F.col("d")).cast("string"), parse.year(F.col("y")), text.normal_title(F.col("t"))).collect()
    assert [r[0] for r in out] == [7, None, None, 10, None]
    assert [r[1] for r in out] == ["2020-02-29", None, None, "2020-01-01", None]
    assert [r[2] for r in out] == [1999, None, None, None, None]
    assert [r[3] for r in out] == ["elan again", "le", None, "a", ""]


def test_export_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ann.zip", "w") as z:
        z.writestr("x/ratings.csv", "﻿Date,Name,Year,Letterboxd URI,Rating \n2020-01-02,A,1999,u1,4\n2020-01-05,A,1999,u1,3.5\n2020-01-01,B,x,,2\n")
        z.writestr("diary.csv", "Date,Name,Year,Letterboxd URI,Rating,Rewatch,Watched Date\n2020-01-09,A,1999,u1,5,Yes,2020-01-04\n")
        z.writestr("other.csv", "a,b\n1,2\n")
    raw = exports.read_exports(spark, f"file://{tmp_path}")
    good, bad = exports.parted(raw)
    assert bad.count() == 1 and bad.first().reason == "no uri" and good.count() == 3
    row = exports.folded(exports.typed(good)).first()
    assert (row.user, row.uri, row.rating_half, str(row.watched_at), str(row.logged_at), row.diary_rows, row.rewatch) == ("ann", "u1", 7, "2020-01-04", "2020-01-02", 1, True)


def test_payloads(spark):
    raw = spark.createDataFrame([('{"id": 1, "extra": [1], "genres": [{"id": 2, "name": "g"}], "credits": {"cast": [{"id": 9, "ord": 1}, {"id": 8, "ord": 0}], "crew": [{"id": 7, "role": "director"}, {"id": 6, "role": "cook"}]}, "releases": [{"dates": ["1999-01-01T", "bad"]}, {"dates": ["1998-05-05", null]}]}',), ("no json",)], "payload string")
    parts = catalogue.shredded(catalogue.parsed(raw), billed=1)
    assert [tuple(r) for r in parts["cast"].collect()] == [(1, 8, 0, None)] and [r.person for r in parts["crew"].collect()] == [7]
    assert parts["items"].where("id = 1").first().years == [1998, 1999] and parts["genres"].count() == 1


def test_scaling_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = [("mad", i, float(v)) for i, v in enumerate(rng.normal(size=25))] + [("rank", i, float(i == 3)) for i in range(12)] + [("few", i, float(i)) for i in range(7)] + [("same", i, 2.0) for i in range(9)]
    out = quantiles.scaled(spark.createDataFrame(data, "feature string, item long, value double"), ["feature"]).toPandas()
    v = np.array([x for f, _, x in data if f == "mad"])
    mad = np.clip((v - np.median(v)) / (1.4826 * np.median(np.abs(v - np.median(v)))), -3, 3)
    assert np.allclose(out[out.feature == "mad"].sort_values("item").scaled, mad)
    ranks = out[out.feature == "rank"].set_index("item").scaled
    assert np.isclose(ranks[3], 1.0) and np.isclose(ranks[0], 2 * 5 / 11 - 1)
    assert (out[out.feature.isin(["few", "same"])].scaled == 0).all() and set(out[out.feature == "same"].how) == {"zeroed"}


def test_leave_one_out_against_refits():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(14, 3)), rng.normal(size=14)
    for strength in (0.1, 5.0):
        want = []
        for k in range(14):
            # the intercept of all rows stays, as the closed form has it
            c, r = np.delete(x - x.mean(0), k, 0), np.delete(y - y.mean(), k)
            w = np.linalg.solve(c.T @ c + strength * np.eye(3), c.T @ r)
            want.append(y[k] - y.mean() - (x[k] - x.mean(0)) @ w)
        assert np.allclose(taste.leave_one_out(x, y, np.array([strength]))[0], want)


def test_modes_find_planted_clusters(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = []
    for k in range(3):
        for j in range(30):
            v = basis[k] + 0.1 * rng.normal(size=12)
            rows.append((1, 100 * k + j, 1.0 if k < 2 else -1.5, 1.0, v.tolist()))
    out = taste.modes(spark.createDataFrame(rows, "user long, item long, z double, mass double, v array<double>")).toPandas()
    likes = out[out.polarity == "like"]
    assert len(likes) == 2 and sorted(likes.members) == [30, 30] and (likes.coherence > 0.8).all()
    assert sorted(int(np.argmax(np.abs(basis @ np.array(c)))) for c in likes.centroid) == [0, 1]


def test_metrics_against_definitions(spark):
    ranked = spark.createDataFrame([(1, i, r) for r, i in enumerate([5, 3, 9, 1], 1)], "user long, item long, rank int")
    judged = spark.createDataFrame([(1, 3, 3), (1, 1, 1), (1, 7, 2), (2, 4, 3)], "user long, item long, rel int")
    got = {r.user: r for r in evaluation.metrics(ranked, judged).collect()}
    ideal = 7 + 3 / np.log2(3) + 1 / 2
    assert np.isclose(got[1].ndcg, (7 / np.log2(3) + 1 / np.log2(5)) / ideal) and got[1].recall == 0.5 and got[1].mrr == 0.5
    assert got[2].ndcg == 0 and got[2].mrr == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    values = spark.createDataFrame([("a", i, float(i % 7)) for i in range(80)], "arm string, id long, value double")
    one = evaluation.bootstrap_mean(values, ["arm"], 200).first()
    assert one == evaluation.bootstrap_mean(values.repartition(5), ["arm"], 200).first() and one.lo < one.point < one.hi


def test_tables_follow_their_updates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 4), (3, "d", 1), (1, "z", 1)], "k int, v string, t int")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(upsert.latest_wins(old, new, ["k"], "t")) == [(1, "z", 1), (2, "b", 5), (3, "d", 1)]
    assert key(upsert.frozen_first(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "b", 4), (3, "d", 1)]
    assert key(upsert.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "d", 1)]
    assert key(upsert.pruned(old, new, "k")) == [(1, "a", 1), (2, "b", 5)]


def test_depths_and_streaks(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    tree = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 20)], "n long, up long")
    assert sorted(map(tuple, logs.depths(tree, "n", "up").collect())) == [(i, i) for i in range(20)]
    log = spark.createDataFrame([(1, t, b) for t, b in enumerate([0, 1, 1, 0, 1, 1, 1])] + [(2, 0, 0)], "k int, t int, b int")
    assert sorted(map(tuple, logs.streaks(log, ["k"], ["t"], F.col("b") == 1).collect())) == [(1, 3), (2, 0)]


def test_calibrated_signals(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        mean = float(rng.uniform(2, 4))
        rows.append((1, i, mean + (0.5 if i % 2 else -0.5) + 0.01 * float(rng.normal()), mean, 50, i % 3, "g"))
    rows += [(2, i, float(i % 5), 3.0, 10, 0, "g") for i in range(10)] + [(1, 99, 3.0, None, None, None, None)]
    out = taste.calibrated(spark.createDataFrame(rows, "user long, item long, stars double, mean double, votes long, decade long, genre string")).toPandas()
    one, two = out[out.user == 1].set_index("item"), out[out.user == 2]
    # the mean explains much of the rating; what is left is the planted half star, up or down
    assert one.r2.iloc[0] > 0.4 and (np.sign(one.residual.drop(99)) == np.where(one.index[:-1] % 2, 1, -1)).mean() > 0.9
    assert np.allclose(two.residual, two.z) and (two.r2 == 0).all() and np.isclose(one.residual[99], one.z[99])
    assert np.allclose(out.s, 0.6 * out.z + 0.4 * out.residual)


def test_title_leaks_of_every_item(spark):
    from quillon.plans.tables import title_leaks

    long = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {long} y"), (1, f"x {long} y"), (2, "one two three four five six seven eight ten"), (None, "short item"), (4, ""), (5, None), (6, "shortest items")], "doc_id long, t string")
    needles = spark.createDataFrame([(7, "short item"), (8, long), (900, long), (900, long), (10, "item"), (11, None), (12, "")], "item_id long, needle string")
    assert sorted(map(tuple, title_leaks(docs, needles).collect())) == [(7, 1), (8, 2), (10, 1), (12, 1), (900, 4)]
    assert title_leaks(docs, needles.limit(0)).count() == 0


def test_paired_arms_reach_behind_what_a_user_has_seen(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillon.plans import evaluation as ev

    items = spark.range(2200).select(F.col("id").alias("item"), F.col("id").cast("double").alias("popularity"))
    seen = spark.range(2100).select(F.lit(1).cast("long").alias("user"), F.col("id").alias("item"))
    test = spark.createDataFrame([(1, 2110, 3, 10), (2, 5, 3, 10)], "user long, item long, rel int, rating_half int")
    monkeypatch.setattr(ev.T, "items", lambda spark, sf: items)
    monkeypatch.setattr(ev, "judged", lambda spark, sf: (test, seen))
    arms = []
    told = ev.S.intervals
    monkeypatch.setattr(ev.S, "intervals", lambda *a: (arms.extend(a[1:]), told(*a))[1])
    ev.paired(spark, None)
    cheap = {u: [r.item for r in arms[1].where(F.col("user") == u).orderBy("rank").collect()] for u in (1, 2)}
    assert cheap == {1: list(range(2100, 2150)), 2: list(range(50))}


def test_silhouette_of_many_points_needs_no_matrix_of_pairs():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8)) + np.repeat(np.eye(8)[:2] * 4, 2000, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, w = np.repeat([0, 1], 2000), np.ones(4000)
    tracemalloc.start()
    got = taste.silhouette(x, labels, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = 1 - x @ x.T
    inside, outside = [np.array([np.where(np.arange(4000) // 2000 == (i // 2000 + o) % 2, far[i], 0).sum() / (1999 + o) for i in range(4000)]) for o in (0, 1)]
    assert abs(got - np.mean((outside - inside) / np.maximum(inside, outside))) < 1e-6 and peak < 20 << 20


def test_a_head_reaches_as_far_as_it_was_seen(spark, monkeypatch):
    from quillon.plans import evaluation as ev

    items = spark.range(2200).select(F.col("id").alias("item"), (-F.col("id")).cast("double").alias("popularity"))
    # the first user has seen the 2,000 least popular items, which its list never meets
    seen = spark.range(200, 2200).select(F.lit(1).cast("long").alias("user"), F.col("id").alias("item")).union(spark.createDataFrame([(2, 0), (2, 0), (2, 2)], "user long, item long"))
    pairs, ranked = [], ev.ranking.ranked
    monkeypatch.setattr(ev.ranking, "ranked", lambda rows, *a: (pairs.append(rows.count()), ranked(rows, *a))[1])
    out = ev.unseen(items, spark.createDataFrame([(1,), (2,)], "user long"), seen)
    got = {u: [r.item for r in out.where(F.col("user") == u).orderBy("rank").collect()] for u in (1, 2)}
    assert got == {1: list(range(50)), 2: [1, *range(3, 52)]} and pairs == [100]


def test_affinities_without_support_sort_nothing(spark):
    from quillon.operators import affinity

    rated = spark.createDataFrame([(u, i, (i % 5) - 2.0) for u in (1, 2) for i in range(30)], "user long, item long, z double")
    bridge = spark.createDataFrame([(k, str(i % m), i) for i in range(40) for k, m in (("director", 7), ("keyword", 3))], "kind string, entity string, item long")
    plain = affinity.affinities(rated, bridge, support=False)
    assert sorted(plain.collect()) == sorted(affinity.affinities(rated, bridge).drop("support").collect())
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_affinities_of_what_is_asked_for(spark):
    from quillon.operators import affinity

    rated = spark.createDataFrame([(u, i, (i % 5) - 2.0) for u in (1, 2) for i in range(30)], "user long, item long, z double")
    bridge = spark.createDataFrame([(k, str(i % m), i) for i in range(40) for k, m in (("director", 7), ("keyword", 3))], "kind string, entity string, item long")
    among = [(1, "director", "3"), (1, "keyword", "1"), (2, "director", "6")]
    every = {(r.user, r.kind, r.entity): r for r in affinity.affinities(rated, bridge).collect()}
    got = affinity.affinities(rated, bridge, F.col("kind") == "director", spark.createDataFrame(among, "user long, kind string, entity string")).collect()
    assert sorted((r.user, r.kind, r.entity) for r in got) == among
    for r in got:
        want = every[r.user, r.kind, r.entity]
        assert r[:6] == want[:6] and r.support == (want.support if r.kind == "director" else None)


def test_hooks_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb
    import pandas as pd

    from quillon.plans import catalogue

    broken = "word " * 34 + "last line\nnext " + "word " * 9  # the cut falls behind a line break
    texts = ["", "   ", None, "One. Two", "One two", "\n\n", broken, "x" * 200, "One!\n", ("a " * 89) + "b\n" + "c" * 9]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    want = {int(r[0]): r[1] for r in con.sql(catalogue.ORACLE_SQL["sc10_hooks"]).fetchall()}
    assert {r.doc_id: r.hook for r in catalogue.QUERIES["sc10_hooks"](spark, str(tmp_path)).collect()} == want


def test_sides_of_a_user_are_groups_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, 1.0 if i < 40 else -1.0 if i < 80 else -0.2, 1.0, (np.eye(4)[i % 2] + 0.1 * rng.normal(size=4)).tolist()) for i in range(120)]
    out = taste.modes(spark.createDataFrame(rows, "user long, item long, z double, mass double, v array<double>"))
    assert sorted((r.polarity, r["mode"], r.members) for r in out.collect()) == [("dislike", 0, 20), ("dislike", 1, 20), ("like", 0, 20), ("like", 1, 20)]
    assert "side" in out._jdf.queryExecution().optimizedPlan().toString()
