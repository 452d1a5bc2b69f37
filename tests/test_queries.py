"""Every registered query against its SQL over the smallest tables; those without SQL give rows of a stable schema."""

import functools
import math
import os

import duckdb
import pytest

from quillon.plans.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", autouse=True)
def shared():
    """What several queries build on is computed once for this module."""
    from quillon.plans import experiments, learning, recommend

    with pytest.MonkeyPatch.context() as patch:
        for module, name in ((learning, "values"), (learning, "fits"), (recommend, "lists"), (experiments, "results")):
            patch.setattr(module, name, functools.lru_cache(getattr(module, name)))
        yield


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(frame, columns):
    return sorted(str(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        rows_of = got.collect()
        assert got.columns and all(len(r) == len(got.columns) for r in rows_of)
        return
    got, want = got.toPandas(), oracle.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_contract(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
