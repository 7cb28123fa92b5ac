"""Every query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tabmine.jobs.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    key = lambda row: [(v is None, str(v) if isinstance(v, (str, bool)) else "", v if isinstance(v, (int, float)) else 0) for v in row]
    return sorted((tuple(cell(v) for v in row) for row in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(out.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
