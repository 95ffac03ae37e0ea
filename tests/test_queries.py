"""Every registered query against its SQL twin on the smallest data; the rest must run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracles import TABLES, rows_of  # noqa: E402

from marquee.plans.registry import QUERIES  # noqa: E402

SLOW = {"joi_07_reconcile"}  # tested on its own in test_reconcile
NAMES = [n for n in QUERIES if n not in SLOW]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols, mine = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    assert sql is not None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    ocols, theirs = rows_of(names, cur.fetchall())
    assert cols == ocols and mine == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pos", "id", "region", "start_day", "end_day"] and df.count() > 0


def test_names():
    assert not [n for n in entry.oracle_sql() if n not in entry.queries()]
    assert set(QUERIES) <= set(entry.queries())
