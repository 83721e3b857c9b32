"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
from decimal import Decimal

import duckdb
import pytest

from lodemill.plans import queries_commands, queries_core, queries_geometry, queries_more, queries_select, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, isinstance(x, (int, float)), x if isinstance(x, (int, float)) else str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    rows = [tuple(map(value, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in registry.ORACLE_SQL:
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert ordered(rows) == ordered([tuple(value(r[i]) for i in at) for r in cur.fetchall()])
