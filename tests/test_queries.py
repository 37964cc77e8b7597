"""Every query of the catalogue against DuckDB."""

import pytest
from helpers import compare

from pathlark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])
