"""The training-data queries that SQL can express against DuckDB, over the whole smallest tables."""

import duckdb
import pytest

from culprit.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = Q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want))
