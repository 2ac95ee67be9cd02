"""The driver contract: queries and SQL agree on names, and the flagship runs."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
