"""Every core query runs at the smallest scale and gives the rows of its SQL."""

import math
import os

import pytest

from tarrafa import queries

SF = os.environ.get("TARRAFA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name in queries.SQL:
        r = duck.sql(queries.SQL[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr) == rows
