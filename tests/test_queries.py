"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from punctua import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return None if isinstance(value, float) and math.isnan(value) else round(float(value), 9)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((repr([plain(r[c]) for c in columns]) for r in got.collect()))
    if name not in registry.ORACLE_SQL:
        pytest.skip("no SQL")
    cursor = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
