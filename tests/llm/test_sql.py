import os

import pytest

from tests import oracle
from weft.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.exists(f"{oracle.DATA}/documents.parquet"), reason="no generated tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    oracle.check(spark, oracle.connect(), QUERIES[name], SQL[name])
