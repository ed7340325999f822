import pytest

from nearfield.llm import queries as Q
from tests.oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, con, name):
    compare(Q.queries()[name](spark, f"{DATA}/sf0.01"), con, Q.oracle_sql()[name])
