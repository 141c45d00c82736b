import pytest

from auklet.plans import catalog
from tests.oracle import differ


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differ(spark, catalog.queries()[name], catalog.oracle_sql()[name]) is None
