"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ELSEWHERE = ("op", "pipeline")      # without SQL: tested next to their operators


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if v is not None and not isinstance(v, (int, str)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    n for n in entry.queries() if n in entry.oracle_sql() or not n.startswith(ELSEWHERE)])
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, cur.fetchall())
