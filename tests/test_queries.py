"""Every query with SQL against DuckDB, and the small fixtures."""

import math
import os

import duckdb
import pytest

from spindrift import queries_behaviour, queries_catalog, queries_models, queries_parts  # noqa: F401 - they register theirs
from spindrift.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert have == want
