from __future__ import annotations

import os

import pytest
from compare import compare

from tracelode.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    mine, theirs, first = compare(spark, DATA, name, QUERIES[name], ORACLE.get(name))
    assert first is None and (theirs is None or mine == theirs)
