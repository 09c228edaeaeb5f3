import pytest
from oracle import compare

from lorecast.plans.registry import core_queries


@pytest.mark.parametrize("name", [n for n, (_, sql) in core_queries().items() if sql])
def test_core_query_matches_sql(spark, name):
    compare(spark, name)
