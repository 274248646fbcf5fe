"""Every registered query against its SQL statement on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from checks import all_queries, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    text, same = compare.compare(spark, con, FOLDER, name, all_queries.QUERIES[name], all_queries.ORACLE.get(name))
    assert same, text


def test_every_query_has_sql():
    assert set(all_queries.QUERIES) == set(all_queries.ORACLE)
    assert set(all_queries.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
