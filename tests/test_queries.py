"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

from lectern.queries import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return str(list(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in pdf[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, DATA).toPandas()
    if name in oracle_sql():
        assert rows(found) == rows(duck.execute(oracle_sql()[name]).df())
    else:
        assert len(found.columns)  # rows are tested in test_operators


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
