"""Every registered query of the library against its SQL, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rulespark.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    done = database.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(map(plain, r)) for r in done.fetchall()]
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
