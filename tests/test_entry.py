from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


def test_contract():
    names = set(entry.queries())
    assert set(SQL) <= names and len(names) > 150


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["b_terms_sub", "b_histogram", "q_bool_msm", "t_bm25", "w_derivative", "g_expand_2hop", "d_bulk", "p2_found"])
def test_queries_equal_their_sql(spark, db, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = db.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
