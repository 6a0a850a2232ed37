"""Every registered query with a SQL form must equal it on the given tables."""

import os

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got = entry_points.queries()[name](spark, FOLDER)
    want = sql.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_every_query_name_is_known():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
