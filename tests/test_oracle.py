"""Every query against its SQL definition."""

import pytest

from tests.conftest import SF
from verification.check import compare, connect
from verification.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_definition_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
