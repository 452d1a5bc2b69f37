"""The run matrix: identities, one pass for all arms, and nothing run twice."""

import random

import pytest

from quillon.operators import evaluation, runs


def test_arms_run_once_and_are_compared(spark, tmp_path):
    rng = random.Random(2)
    configs = {"base": {"weights": {"x": 1.0, "y": -0.5}}, "masked": {"weights": {"x": 1.0, "y": -0.5}, "zeroed": ["y"]}, "other": {"weights": {"z": 1}}}
    told = runs.arms(spark, configs)
    named = {r.arm: r for r in told.collect()}
    assert named["masked"].weights == {"x": 1.0} and all(len(r.sha) == 16 for r in named.values()) and len({r.sha for r in named.values()}) == 3
    again = runs.arms(spark, {"base": {"weights": {"y": -0.5, "x": 1.0}}})
    assert again.first().sha == named["base"].sha  # order is no part of an identity
    users = [8, 9, 16]
    raw = {(u, i, f): rng.choice([-1.0, 0.0, 0.5, 2.0]) for u in users for i in range(30) for f in "xyz" if rng.random() < 0.8}
    judged = {(u, i): rng.randint(0, 3) for u in users for i in rng.sample(range(30), 6)}
    values = spark.createDataFrame([(*k, v) for k, v in raw.items()], "user long, item long, feature string, scaled double").repartition(4)
    rels = spark.createDataFrame([(*k, v) for k, v in judged.items()], "user long, item long, rel int")
    out = runs.Results(spark, f"file://{tmp_path}/runs")
    people = spark.createDataFrame([(u,) for u in users], "user long")
    assert out.rows().count() == 0
    assert out.run(told.where("arm <> 'other'"), people.where("user < 16"), values, rels) == 4
    assert out.run(told, people, values, rels) == 5 and out.run(told, people, values, rels) == 0
    got = {(r.arm, r.user, r.metric): r.value for r in out.rows().collect()}
    assert len(got) == 27 == out.rows().count()
    for arm, c in configs.items():
        weights = {f: w for f, w in c["weights"].items() if f not in c.get("zeroed", ())}
        ranked = []
        for u in users:
            items = {i for v, i, _ in raw if v == u}
            score = {i: round(sum(weights.get(f, 0) * raw.get((u, i, f), 0) for f in "xyz"), 9) for i in items}
            ranked += [(u, i, r) for r, i in enumerate(sorted(items, key=lambda i: (-score[i], i)), 1)]
        plain = evaluation.metrics(spark.createDataFrame(ranked, "user long, item long, rank int"), rels)
        for r in plain.collect():
            assert [got[arm, r.user, m] for m in runs.METRICS] == pytest.approx([r.ndcg, r.recall, r.mrr])
    deltas = {(r.arm, r.metric): r for r in runs.deltas(out.rows(), "base").collect()}
    by_fold = [[got["other", u, "ndcg"] - got["base", u, "ndcg"] for u in us] for us in ((8, 16), (9,))]
    means = [sum(d) / len(d) for d in by_fold]
    assert deltas["other", "ndcg"].delta == pytest.approx(sum(means) / 2) and deltas["other", "ndcg"].better == sum(m > 1e-12 for m in means)


def test_rows_of_features_are_not_multiplied_by_arms(spark):
    told = runs.arms(spark, {"a": {"weights": {"x": 1.0}}, "b": {"weights": {"y": 2.0}}})
    values = spark.createDataFrame([(1, i, f, float(i)) for i in range(5) for f in "xy"], "user long, item long, feature string, scaled double")
    due = told.select("arm", "sha").crossJoin(spark.createDataFrame([(1,)], "user long"))
    out = runs.rankings(due, told, values, 2)
    assert sorted((r.arm, r.item, r["rank"]) for r in out.collect()) == [("a", 3, 2), ("a", 4, 1), ("b", 3, 2), ("b", 4, 1)]
    assert "Aggregate [arm" not in out._jdf.queryExecution().optimizedPlan().toString()
