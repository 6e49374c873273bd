"""Every registered query against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from cohort_queries import catalogue, oracle

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF_DIR}/orders.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    want = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    assert Counter(map(tuple, df.select(*columns).collect())) == want


def test_every_order_is_a_subject(spark, duck):
    rows = catalogue.table(spark, SF_DIR).where("copy = 0").select("subject_id").collect()
    orders = duck.execute("SELECT CAST(o_orderkey AS VARCHAR) FROM orders").fetchall()
    assert Counter(r[0] for r in rows) == Counter(r[0] for r in orders)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
