import pytest

from auklet.llm import registry
from tests.oracle import differ


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differ(spark, registry.queries()[name], registry.oracle_sql()[name]) is None
