"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lotwise.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


def plain(v):
    """A value in a form that both engines share: numbers to nine significant digits, nested values by part."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}".replace("-0", "0", 1) if float(v) == 0 else f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return str([plain(x) for x in v])
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted_rows(df.columns, rows) == sorted_rows(names, got.fetchall())


def test_sql_is_of_queries():
    assert set(SQL) <= set(queries())


def test_queries_without_sql_are_those_that_have_tests_of_their_own():
    assert set(queries()) - set(SQL) == {"dom11_near_clusters", "str33_redact_documents"}
