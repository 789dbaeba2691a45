"""Every query against its SQL in DuckDB."""

import datetime

import duckdb
import pytest

from stratalog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return round(value, 6) if isinstance(value, float) else value


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_every_query_gives_rows(spark):
    empty = {n for n, q in registry.QUERIES.items() if not q(spark, "/root/testdata/sf0.01").limit(1).count()}
    assert empty <= {"storage_pressure"}
