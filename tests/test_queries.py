"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from strataline.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalogue.oracle_sql():
        r = duck.execute(catalogue.oracle_sql()[name])
        names = [x[0] for x in r.description]
        want = sorted(repr(tuple(plain(x[names.index(c)]) for c in columns)) for x in r.fetchall())
        assert sorted(names) == columns and got == want


def test_hits_have_their_whole_content(spark):
    texts = {f"doc:{r.doc_id}": r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    hits = catalogue.queries()["format_hits_budget"](spark, DIR).collect()
    assert any(len(texts[r.url]) > 200 for r in hits)
    assert all(r.content == texts[r.url] for r in hits)
