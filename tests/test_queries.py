"""Every named query against its SQL, on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from grootboek.plans.oracle import ORACLE
from grootboek.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "embeddings", "events", "nation", "orders")


@pytest.fixture(scope="session")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(rows, names, order):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted([tuple(cell(r[names.index(c)]) for c in order) for r in rows], key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    result = database.execute(entry.oracle_sql()[name])
    names, expected = [c[0] for c in result.description], result.fetchall()
    df = entry.queries()[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(names)
    assert _plain([tuple(r) for r in df.collect()], df.columns, order) == _plain(expected, names, order)
