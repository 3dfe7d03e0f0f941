"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import __spark_entry__ as entry
import pytest
from check_oracles import compare
from faultloom.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))  # the optional parts have tests of their own
def test_query(spark, name):
    assert compare(spark, SF, [name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[-2:] == ["count", "percent"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
