"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def rows(names, data):
    order = sorted(names)
    return sorted((tuple(plain(r[names.index(n)]) for n in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    c = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, c.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
