"""Every query with an oracle against DuckDB on the smallest tables."""

import pytest
from compare import difference, oracle

from scanlake.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), oracle(ORACLES[name], SF)) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
