"""Every job with SQL gives the SQL's rows on the smallest tables; the rest run."""

import os

import duckdb
import pytest

from attestry import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(int(value)) if isinstance(value, (int, float)) and value == int(value) else str(round(value, 6) if isinstance(value, float) else value)


def rows(names, table):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in table], key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_job(spark, duck, name):
    query, sql = catalog.JOBS[name]
    found = query(spark, SF)
    got = [tuple(r) for r in found.collect()]
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, got) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert catalog.flagship(spark, SF).count() > 0
