"""Every named query on the smallest tables, against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from postmill.plans import catalog, checks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


NAMES = [f.__name__ for f in catalog.QUERIES]


def test_every_query_has_sql():
    assert set(NAMES) == set(checks.oracle_sql())
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    diff, _ = compare(spark, con, SF, name)
    assert diff == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["email", "n_postings"] and df.count() > 0
