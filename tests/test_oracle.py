import os

import pytest

import __spark_entry__ as registered
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, con, name):
    frame = registered.queries()[name](spark, FOLDER)
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert frame.columns and frame.count() >= 0
    else:
        assert oracle.compare(frame, con, sql) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 15


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
