import duckdb
import pytest

from grootboek.llm.oracle import ORACLE
from grootboek.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    names, expected = [c[0] for c in result.description], result.fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, df.select(*names).collect())) == sorted(
        repr(r) for r in spark.createDataFrame(expected, df.select(*names).schema).collect()
    )


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
