"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
