import pytest

from forgepulse import queries as Q

from .compare import difference

NAMES = sorted(Q.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, name):
    df = Q.queries()[name](spark, small)
    assert difference(df, Q.oracle_sql()[name], small) == ""
