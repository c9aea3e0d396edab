"""Every registered query of the engine runs over whole tables; those with SQL agree with it."""

import duckdb
import pytest

from quern import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(None if x != x else x for x in r) for r in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, small_dir, name):
    assert rows(catalog.queries()[name](spark, small_dir).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small_dir, name):
    assert catalog.queries()[name](spark, small_dir).count() >= 0
