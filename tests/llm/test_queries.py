import os

import pytest

from duplika.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import DATA, both

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLE_SQL[name])
    assert got == want
