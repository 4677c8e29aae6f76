import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as contract

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    wrong = differences(contract.queries()[name](spark, SF), con, SQL[name])
    assert not wrong, (len(wrong), wrong[:3])
