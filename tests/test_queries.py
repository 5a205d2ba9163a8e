"""Every registered query on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare
from lookout import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert name in catalog.SQL, "a query without SQL checks nothing"
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.count() > 0
    assert "risk_level" in first.columns
