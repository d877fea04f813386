"""Every registered query against its SQL twin, on whole tables."""

import pytest

import check
from parity.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    good, note = check.compare(spark, con, name, SF)
    assert good, note
