"""Every registered query against its DuckDB oracle on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tidemark.registry import ORACLE_SQL, QUERIES  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from scripts.check_oracle import compare, duck  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF_SMALL, name)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["pickup_zone", "total_revenue"]
    assert df.count() >= 0


def test_every_query_has_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLE_SQL)
    assert not rows_only
