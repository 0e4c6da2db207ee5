"""Every registered query with a SQL counterpart, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    assert entry(spark).count() > 0
