"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from normweave import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    assert rows, "a query without rows proves nothing"
    names = ", ".join(f'"{c}"' for c in cols)
    assert rows == sorted(map(repr, duck.execute(f"SELECT {names} FROM ({sql})").fetchall()))


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hybrid_retrieval" in entry.queries()
