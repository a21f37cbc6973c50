import pytest

from forgepulse.llm import queries as Q
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert difference(Q.queries()[name](spark, small), Q.oracle_sql()[name], small) == ""
