"""Fuzzy names and as-of joins against all pairs."""

import datetime as dt
import random

import pytest

from quillon.operators import asof, fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.75])
def test_no_close_name_is_lost(spark, least):
    rng = random.Random(4)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(0, 9))) for _ in range(120)} | {"small ring", "small rang", "aaaaaaaa", "aaaaaaa", ""}
    asked = {"".join(rng.choice("abé ") for _ in range(rng.randint(0, 9))) for _ in range(60)} | {"smal ring", "aaaaaa", ""}
    a = spark.createDataFrame([(x,) for x in [*asked, None, "smal ring"]], "asked string").repartition(3)
    b = spark.createDataFrame([(x,) for x in [*names, None, "small ring"]], "name string").repartition(3)
    want = {}
    for x in asked:
        for y in names:
            s = 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0
            if s >= least - 1e-9:
                want[x, y] = s
    got = {(r.asked, r.name): r.similarity for r in fuzzy.close(a, b, least).collect()}
    assert got == pytest.approx(want) and len(want) > 20
    top = fuzzy.suggestions(a, b, 2, least).where("asked = 'smal ring'").orderBy("place").collect()
    assert [r.name for r in top][:1] == ["small ring"] and len(top) == min(2, sum(x == "smal ring" for x, _ in want))


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before_with_a_key_of_half_the_rows(spark, inclusive):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    time = lambda: start + dt.timedelta(seconds=rng.randint(0, 3000), microseconds=rng.choice([0, 5]))
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    reads = [(key(), time(), i) for i in range(300)] + [("a", None, 900), ("nothing", start, 901)]
    writes = [(key(), time(), rng.randint(0, 9)) for _ in range(200)] + [("hot", None, 5)]
    left = spark.createDataFrame(reads, "k string, ts timestamp, id long").repartition(4)
    right = spark.createDataFrame(writes, "k string, ts timestamp, v long").repartition(4)
    want = {}
    for k, t, i in reads:
        fits = [(u, v) for j, u, v in writes if j == k and t is not None and u is not None and (u <= t if inclusive else u < t)]
        want[i] = max(fits, default=None)
    for width in (60, 100_000):
        got = asof.last_before(left, right, ["k"], "ts", right.v, width, inclusive=inclusive)
        assert got.columns == ["k", "ts", "id", "last"]
        assert {r.id: tuple(r.last) if r.last else None for r in got.collect()} == want
