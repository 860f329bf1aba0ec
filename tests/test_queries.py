"""Every query against its SQL twin; those without one must at least give rows."""

import pytest

from granary import catalog

from . import oracle

PATH = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(PATH)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert oracle.difference(spark, QUERIES[name], ORACLES[name], PATH, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, PATH).limit(1).count() == 1
