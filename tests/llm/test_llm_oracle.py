"""Registered queries of the subpackage against their SQL, and the driver contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from photolake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    frame = queries.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted(str(tuple(r)) for r in frame.select(*cols).collect())
    assert got and got == sorted(str(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/photolake/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "photolake.llm" not in open(path).read(), path
