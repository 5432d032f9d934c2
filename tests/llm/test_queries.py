import pytest

from strataline.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert df.count() >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    r = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(r.fetchall())
