"""Every registered query runs; those with SQL give the SQL's rows."""

import pytest
from row_checks import same_rows

from formwright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    same_rows(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_grid_joins_compare_no_pairs(spark, sf_dir):
    for name in ("point_in_parcel", "dwithin_pairs", "touching_buildings"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
