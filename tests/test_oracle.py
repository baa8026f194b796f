"""Every registered SQL equivalent gives the rows of its query."""

import pytest

from tests.conftest import SMALL
from tests.harness import compare, duck
from txnrisk.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_names_match():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SMALL, queries()[name], oracle_sql()[name])
    assert ok, message


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "trans_num"
