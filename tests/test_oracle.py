"""Every registered query against its SQL on small test tables; a result must not be empty."""

import os

import pytest
from compare import connect, spark_rows, sql_rows
from conftest import TESTDATA

from nightdesk.plans.catalog import ORACLE, QUERIES

SF_DIR = f"{TESTDATA}/sf{os.environ.get('ORACLE_SF', '0.01')}"

#: Right but empty at this scale.
MAY_BE_EMPTY: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = spark_rows(df)
    assert got or name in MAY_BE_EMPTY
    if name in ORACLE:
        names, expected = sql_rows(con, ORACLE[name])
        assert sorted(df.columns) == names
        assert got == expected
