"""Every registered query of the engine against its SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from varloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "lineitem", "customer")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple("" if row[k] is None else repr(row[k]) for k in order) for row in rows])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows(spark, con, name):
    found = queries.queries()[name](spark, SF)
    if name not in queries.oracle_sql():
        assert found.count() > 0
        return
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: kinds[t] for c, t in found.dtypes} == types
    got, rows = [tuple(r) for r in found.collect()], want.fetchall()
    assert got and canonical(got, found.columns) == canonical(rows, want.columns)
