import os

import duckdb
import pytest

from keystrata.plans import catalogue, file_queries, store_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES = catalogue.queries() | store_queries.queries() | file_queries.queries()
SQL = catalogue.oracle_sql() | store_queries.oracle_sql() | file_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.toArrow().to_pylist())))
    answer = duck.sql(SQL[name])
    columns = answer.columns
    wanted = sorted(map(repr, (tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in answer.fetchall())))
    assert sorted(columns) == sorted(df.columns)
    assert found == wanted


def test_the_entry_has_everything(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
