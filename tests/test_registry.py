"""Every registered query against its SQL twin on the smallest tables.

PACKLEDGER_QUERIES narrows the run to comma-separated prefixes.
"""
import os

import pytest

import __spark_entry__ as entry
from compare import connect, rows

ONLY = tuple(x for x in os.environ.get("PACKLEDGER_QUERIES", "").split(",") if x)
NAMES = [n for n in entry.queries() if not ONLY or n.startswith(ONLY)]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, data, con):
    df = entry.queries()[name](spark, data)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    res = con.execute(sql)
    assert got == rows([c[0] for c in res.description], res.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_twins_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
