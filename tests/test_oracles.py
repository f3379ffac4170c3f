"""Every registered query of the engine against its SQL in DuckDB, over the whole smallest tables."""

import datetime
import math

import duckdb
import pytest

from culprit.plans import queries as Q
from culprit.plans.starview import TABLES, Star


@pytest.fixture(scope="module")
def star(spark, sf):
    return Star(spark, sf)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat()[:19]
    if isinstance(v, bool | str):
        return v
    return round(float(v), 6)


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(star, duck, name):
    got = Q.ON_STAR[name](star)
    cursor = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cursor.fetchall())


def test_all_queries_have_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
