"""Preferences against loops over users."""

import random

from pyspark.sql import functions as F

from quillon.operators import preferences as P

KIND = "pref_id long, user long, scope string, session string, kind string, target string, polarity string, strength int, hard boolean, created_at timestamp"


def test_quotes_must_be_the_user_s_words(spark):
    messages = spark.createDataFrame([(1, "I really HATE\n long  films"), (1, ""), (2, "long films"), (2, None)], "user long, text string")
    drafts = [(1, "hate long  FILMS", 2), (1, "te long fi", 1), (2, "hate long films", 2), (1, "ong", 3), (1, "", 1), (1, None, 1), (1, "long films", 4), (3, "long", 1), (1, "long films", None)]
    got = {(r.user, r.quote, r.strength): r.refused for r in P.quoted(spark.createDataFrame(drafts, "user long, quote string, strength int"), messages).collect()}
    assert got == {drafts[0]: None, drafts[1]: None, drafts[2]: "not said", drafts[3]: None, drafts[4]: "not said", drafts[5]: "not said", drafts[6]: "strength", drafts[7]: "not said", drafts[8]: "strength"}


def test_hard_ones_are_clauses_and_soft_ones_weights(spark):
    rng = random.Random(3)
    stamp = lambda k: f"2024-01-{k:02d} 00:00:00"
    rows = []
    for i in range(160):
        kind = rng.choice(["genre", "keyword", "country", "director", "actor", "film", "runtime", "collection"])
        target = str(rng.randint(0, 5)) if kind != "runtime" else f"{rng.randint(40, 90)} min"
        rows.append((i, i % 7, rng.choice(["durable", "session"]), rng.choice(["s1", "s2"]), kind, target, rng.choice(["like", "dislike"]), rng.randint(1, 3), rng.random() < 0.15, stamp(rng.randint(1, 20))))
    table = spark.createDataFrame(rows, KIND.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(4)
    stated = P.active(table, F.lit("s1"), F.lit(stamp(15)).cast("timestamp"))
    last = {}
    for r in sorted(rows, key=lambda r: (r[9], r[0])):
        if r[9] <= stamp(15) and (r[2] == "durable" or r[3] == "s1"):
            last[r[1], r[2], r[4], r[5]] = r
    assert sorted(r.pref_id for r in stated.collect()) == sorted(r[0] for r in last.values())
    has = {i: {(rng.choice(["genre", "keyword", "country", "director", "actor", "collection"]), str(rng.randint(0, 5))) for _ in range(6)} for i in range(12)}
    runtime = {i: rng.choice([None, 30, 60, 80, 120]) for i in has}
    pool = spark.createDataFrame([(u, i) for u in range(7) for i in has], "user long, item long")
    bridge = spark.createDataFrame([(k, e, i) for i, own in has.items() for k, e in own], "kind string, entity string, item long")
    facts = spark.createDataFrame(list(runtime.items()), "item long, runtime int")
    want = set()
    for u in range(7):
        own = [r for r in last.values() if r[1] == u and r[8]]
        for i in has:
            mine = has[i] | {("film", str(i))}
            for r in own:
                if r[4] != "runtime" and r[6] == "dislike" and (r[4], r[5]) in mine:
                    want.add((u, i, "exclude_" + P.CLAUSE[r[4]]))
            for clause in {P.CLAUSE[r[4]] for r in own if r[4] != "runtime" and r[6] == "like"} - {"ids"}:
                if not any((r[4], r[5]) in mine for r in own if r[6] == "like" and P.CLAUSE.get(r[4]) == clause):
                    want.add((u, i, "include_" + clause))
            caps = [int(r[5].split()[0]) for r in own if r[4] == "runtime"]
            if caps and runtime[i] is not None and runtime[i] > min(caps):
                want.add((u, i, "runtime_max"))
    out = P.failing(pool, bridge, facts, stated)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want) and len(want) > 20
    costs = {(r.user, r.clause): r.n for r in P.removed(pool, out).collect()}
    for u in range(7):
        assert costs.get((u, "all"), 0) == len({i for v, i, _ in want if v == u})
    assert {tuple(r) for r in P.allowed(pool, out).collect()} == {(u, i) for u in range(7) for i in has} - {(u, i) for u, i, _ in want}
    soft = {(r.user, r.kind, r.entity, r.weight) for r in P.weights(stated).collect()}
    assert soft == {(r[1], r[4], r[5], (1 if r[6] == "like" else -1) * r[7] * 0.5) for r in last.values() if not r[8]}
