"""Every registered query against its SQL (or for rows), on the smallest tables."""

import os
import warnings

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = check.compare(spark, con, SF, name)
    assert out.startswith("ok") or out.startswith("rows"), out


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
