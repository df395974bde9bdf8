"""Queries of the corpus operators against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessella.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return f"{v + 0.0:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    told = duck.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, FOLDER).select(*told.columns)
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in told.fetchall())
