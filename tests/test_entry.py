"""Driver contract: entry() runs on sf0.001; every catalog query has an oracle."""

import os

import pytest

import __spark_entry__ as E
from emberlog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["bucket_start", "group_name", "count"]
    assert df.count() > 0


def test_catalog_and_oracles_line_up():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(q)
    assert len(catalog.QUERIES) >= 72
