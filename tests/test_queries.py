"""Every query with SQL gives the rows that DuckDB gives."""

import decimal
import os

import duckdb
import pytest

from knotwork import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal) or isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)[:19].replace(" 00:00:00", "")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[df.columns.index(c)]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=str)
