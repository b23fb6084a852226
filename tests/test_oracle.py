"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from plumbline.plans import catalogue


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(name, spark, data, duck):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark, data):
    assert catalogue.queries()[name](spark, data).count() > 0
