import pytest

from lodestream.llm import queries as Q
from lodestream.plans.compare import compare, duck


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, sf, name):
    r = compare(spark, duck(sf), Q.queries()[name], Q.oracle_sql().get(name), sf, Q.CHECKED.get(name), need_rows=False)
    assert r["ok"], r["why"]
