"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


QUERIES = {name: query for module in entry.MODULES for name, query in module.QUERIES.items()}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert difference(QUERIES[name](spark, SF_DIR), db, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["line_no", "kind", "value", "pos"]
