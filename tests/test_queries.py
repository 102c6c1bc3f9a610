"""All linkage queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans.queries import ORACLE_SQL, QUERIES

SLOW = ("er_training_grids", "er_inference")


def plain(v):
    return repr(round(v, 8)) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in ("part", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, con, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - set(SLOW)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_training(spark, data):
    got = QUERIES["er_training_grids"](spark, data).collect()
    assert {r["strategy"] for r in got} == {"logistic", "boosted", "blend_0.5"} and len(got) == 42


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
