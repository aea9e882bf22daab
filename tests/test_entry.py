"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry
from quillflow.plans import catalog

SF = "/root/testdata/sf0.001"


def test_core_alone_is_complete():
    q, s = catalog.queries(), catalog.sql()
    assert set(s) <= set(q) and "leak_free_accept" in q and "p4_found" in q
    assert set(q) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "reason", "n"] and df.count() > 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", ["split_overlap_audit", "manifest_checks", "strict_classes", "match_audit", "p4_found"])
def test_queries_say_something(spark, name):
    assert catalog.queries()[name](spark, SF).limit(2).count() > 0
