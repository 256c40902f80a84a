"""Every query with SQL against DuckDB; the others run."""

from __future__ import annotations

import pytest

from compare import DATA, differences
from kinolith.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert not differences(name, df, SQL[name])
    else:
        assert df.count() > 0
