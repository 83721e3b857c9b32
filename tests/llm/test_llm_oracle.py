"""Queries of the optional part that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(cur.fetchall(), key=key)
    assert want and sorted(map(tuple, df.select(*names).collect()), key=key) == want
