from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
