"""Every registered query against its SQL, or for rows and a stable schema."""

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == []
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
