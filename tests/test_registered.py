"""Every registered query against its SQL twin, on the smallest driver tables."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry
from footfall import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = oracle.compare(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLES[name])
    assert problem is None, problem
