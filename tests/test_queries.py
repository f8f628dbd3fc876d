"""Every registered query at sf0.001 against its DuckDB oracle (the driver's
correctness gate, on the smallest tables), plus the entry smoke check."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from opinio.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"lang", "sentiment", "n", "share"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    exp = con.execute(SQL[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(exp)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
