"""Every registered query against its SQL, on the whole tables of the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import check, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    error, *_ = check(spark, con, name, entry.queries(), entry.oracle_sql(), SF_DIR)
    assert error is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product", "bias", "row", "col", "K", "a", "b", "c", "R2", "RMSE", "MSE"]
    assert df.count() > 0
