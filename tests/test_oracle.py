"""Every registered query against its SQL twin in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from tessera.queries import all_queries, all_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(found):
    def one(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        v = float(v)
        return "nan" if math.isnan(v) else repr(round(v, 8))

    return sorted(tuple(one(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(name, spark, duck, sf):
    df = all_queries()[name](spark, sf)
    names = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({all_sql()[name]})")
    assert sorted(duck.sql(all_sql()[name]).columns) == names
    assert rows(df.select(*[f"`{n}`" for n in names]).collect()) == rows(expected.fetchall())
