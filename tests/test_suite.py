"""Every registered case against its SQL, on the smallest tables."""
import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_case(spark, con, name):
    _, problem = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"segment", "orders"}


def test_every_sql_has_a_case():
    assert set(SQL) <= set(QUERIES)
