"""Every registered query agrees with its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle

import __spark_entry__ as entry
from fleetlake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, name, entry) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["slug", "name", "vendor", "leader", "laggard"]
