"""The queries with SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from logtable.llm import queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, db, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), db, queries.SQL[name]) is None
