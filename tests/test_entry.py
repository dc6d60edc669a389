import importlib

import duckdb
import pytest

from kelpie.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def plain(value):
    return format(value, ".9g") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), db.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    places = [want.columns.index(c) for c in sorted(df.columns)]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
