"""Every registered query against the SQL of its result, on the smallest tables."""

import os

import duckdb
import pytest

from lantern.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA).toArrow()
    if name not in catalogue.ORACLE_SQL:
        assert got.num_rows > 0
        return
    con.register("got", got)
    con.sql(f"CREATE OR REPLACE TEMP TABLE want AS {catalogue.ORACLE_SQL[name]}")
    columns = ", ".join(f'"{c}"' for c in got.column_names)
    assert sorted(r[0] for r in con.sql("DESCRIBE want").fetchall()) == sorted(got.column_names)
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
