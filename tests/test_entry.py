"""The driver's contract: names, SQL for known queries only, and a few queries against their SQL where data is there."""

import os

import pytest

import __spark_entry__ as entry
from caseloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(catalog.queries()) >= 90 and set(catalog.queries()) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["charge", "n", "n_chars"] and df.count() > 0
