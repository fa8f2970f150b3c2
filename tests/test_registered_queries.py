"""Every registered query against its SQL, on the given tables."""

import os
import pathlib

import __spark_entry__ as entry_points
import pytest
from oracle_check import differences

from shelfgauge.plans.oracles import ORACLES
from shelfgauge.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Without the tables these tests fail, unless the caller says that they may be skipped.
pytestmark = pytest.mark.skipif(
    not pathlib.Path(FOLDER).exists() and bool(os.environ.get("TEST_WITHOUT_TABLES")),
    reason="the given tables are not here",
)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), FOLDER, ORACLES[name]) == ""


def test_entry(spark):
    grades = {row.pre_grade: row.n_products for row in entry_points.entry(spark).collect()}
    assert grades == {"A": 87, "B": 58, "C": 40, "D": 13, "F": 2}
