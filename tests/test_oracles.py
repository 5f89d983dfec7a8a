"""Every query with a SQL twin agrees with it at the smallest scale."""

import pytest
from compare import compare
from conftest import SF

from strataframe.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    diff = compare(spark, duck, QUERIES[name], ORACLES[name], SF)
    assert diff is None, diff
