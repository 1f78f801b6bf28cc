"""Every registered query against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from photolake import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def text(v):
    if v is None:
        return "~"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted(tuple(text(v) for v in row) for row in frame.select(*cols).collect())
    assert got
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == sorted(tuple(text(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)
