"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from check import database, difference
from foliant import oracle, workloads
from tests.conftest import SMALL

SQL = oracle.SQL


@pytest.fixture(scope="module")
def duck():
    return database(SMALL)


def test_every_query_has_a_twin():
    assert set(SQL) == set(workloads.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, name):
    ours = entry.queries()[name](spark, SMALL).toPandas()
    theirs = duck.execute(SQL[name]).fetchdf()
    assert difference(ours, theirs) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert all(r["min"] <= r["avg"] <= r["max"] for r in rows)
