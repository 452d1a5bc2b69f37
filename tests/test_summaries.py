import statistics

from pyspark.sql import functions as F

from quillon.operators import summaries as S


def test_a_missing_weight_counts_as_zero(spark):
    fits = {"a": {1: 0.5, 2: -0.25, 3: 1.5}, "b": {2: 2.0}, "c": {1: -1.0, 3: -3.0}, "d": {1: 0.0, 2: 0.0, 3: 0.0}}
    df = spark.createDataFrame([(k, f, w) for f, own in fits.items() for k, w in own.items()], "fold int, feature string, weight double")
    got = {r.feature: r for r in S.stability(df).collect()}
    for feature, own in fits.items():
        w = [own.get(k, 0.0) for k in (1, 2, 3)]
        middle, r = statistics.median(w), got[feature]
        agree = sum((v > 0) == (middle > 0) and (v != 0) == (middle != 0) for v in w)
        assert (r.middle, r.agree, r.active) == (middle, agree, sum(v != 0 for v in w))
        assert abs(r["mean"] - statistics.fmean(w)) < 1e-12 and abs(r.sd - statistics.pstdev(w)) < 1e-12


def test_words_are_taken_out_whole(spark):
    row = lambda name, text: spark.range(1).select(S.without(F.lit(text), S.naming_words(F.lit(name))).alias("t")).first().t
    assert row("The Äch of it", "ÄCH ächzt;  the äch\n was (Äch) of it") == "ächzt; the was ( ) of it"
    assert row("of the", " nothing  goes ") == "nothing goes"
    assert row("one", "") == ""


def test_years_minutes_and_stars(spark):
    text = "In 1987 and 2039, not 2040 or 17999: 95 min, 120 Minutes, 4.5 stars, 3 star and 7 stars"
    got = spark.range(1).select(*(S.found(F.lit(text), p).alias(k) for k, p in (("y", S.YEAR), ("m", S.MINUTES), ("s", S.STARS)))).first()
    assert (got.y, got.m, got.s) == (["1987", "2039"], ["95", "120"], ["4.5", "3"])


def test_ends_and_ratios(spark):
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0), ("g", "c", 3.0), ("h", "z", 0.0)], "g string, name string, v double")
    ends = {(r.side, r.place): r["name"] for r in S.ends(rows.where("g = 'g'"), ["g"], "v", "name", 2).select("side", "place", F.col("name")).collect()}
    assert ends == {("best", 1): "b", ("best", 2): "c", ("worst", 1): "a", ("worst", 2): "b"}
    assert sorted((r["name"], r.ratio) for r in S.ratio_to_median(rows, "v", ["g"]).collect()) == [("a", 1 / 3), ("b", 1.0), ("c", 1.0), ("z", 1.0)]


def test_affinities_without_support_are_not_sorted(spark):
    from quillon.plans import catalogue

    plan = catalogue.QUERIES["tm10_affinities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "abs(z" not in plan  # the order of a support's items
