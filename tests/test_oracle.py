import pytest

from engram.plans import all_queries
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    said = compare(QUERIES[name](spark, SF), con.sql(SQL[name]))
    assert said in (None, "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
