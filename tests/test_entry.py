"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import DATA, compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return duck("0.001")


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "maintainability_score" in frame.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, connection, name):
    same, note = compare(spark, connection, "0.001", name)
    assert same, note
