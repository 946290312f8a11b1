"""Every registered query against its oracle on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import same_rows
from curioshelf.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    got = QUERIES[key](spark, SF_DIR)
    want = con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert same_rows(got.columns, got.collect(), names, want.fetchall())


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["id", "name", "rarity", "cmc"]
    assert entry_point.entry(spark).count() > 0
