"""Every registered query runs; those with SQL match it."""

from __future__ import annotations

import os

import pytest
from compare import compare

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {n: q for m in entry._registered() if ".llm" not in m.__name__ for n, q in m.QUERIES.items()}
SQL = {n: q for m in entry._registered() if ".llm" not in m.__name__ for n, q in m.ORACLE.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(CORE))
def test_query(spark, name):
    mine, theirs, first = compare(spark, DATA, name, CORE[name], SQL.get(name))
    assert first is None and (theirs is None or mine == theirs)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(CORE)
