"""Every query against its SQL counterpart on the smallest tables."""

import pytest

from checks import compare
from checks.oracles import oracles
from checks.queries import QUERIES, run

SF_DIR = "/root/testdata/sf0.001"
EXPECTED = oracles()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in EXPECTED])
def test_same_as_sql(spark, con, name):
    assert compare.differences(run(name, spark, SF_DIR), con, EXPECTED[name]) is None


def test_every_query_has_sql():
    assert set(EXPECTED) == set(QUERIES)
