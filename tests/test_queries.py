"""Every registered query against its oracle, and again over shuffled partitions."""

import pytest
from oracles import oracle_rows, spark_rows

from kvartal.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_oracle(spark, sf_dir, name):
    sql = registry.oracle_sql().get(name)
    names, rows = spark_rows(registry.queries()[name](spark, sf_dir))
    assert len(set(names)) == len(names)
    if sql:
        want_names, want = oracle_rows(sql, sf_dir)
        assert names == want_names and len(rows) == len(want)
        assert rows == want
