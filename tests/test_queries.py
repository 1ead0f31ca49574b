import os

import pytest

from tests import oracle
from weft.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.exists(f"{oracle.DATA}/orders.parquet"), reason="no generated tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    oracle.check(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0
