"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

import mixlab.plans.catalog  # noqa: F401
from mixlab.plans.check import compare
from mixlab.plans.registry import QUERIES

from .conftest import SF01


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF01, [name], verbose=False)[name]
    assert res.startswith("OK") or res.startswith("rows-only"), res
