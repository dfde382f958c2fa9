"""Plan checks: no Python in any engine plan, pushdown reaches the scan, shared exchanges."""
import re

import pytest

from montevar.plans import pipeline as pl
from montevar.plans.catalog import queries
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_in_plans(built_queries, name):
    plan = _plan(built_queries(name))
    assert not any(n in plan for n in PYTHON_NODES)


def test_period_predicate_and_pruning_reach_the_scan(spark):
    study = pl.RiskStudy.from_tables(spark, SF_SMALL, "1997-01-01", "1998-12-31")
    plan = study.stock_returns._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_discount:double,l_shipdate:" in plan


def test_instrument_windows_share_one_exchange(spark):
    """Fill, horizon frame, recency rank, the feature join and the per-instrument fit
    all reuse one hash partitioning by symbol.  The only other exchange on the
    instrument side is the dedup's, keyed by (symbol, day) after map-side partial
    aggregation, which spreads a hot symbol's raw rows over many tasks."""
    study = pl.RiskStudy.from_tables(spark, SF_SMALL, keep=())
    plan = _plan(study.models)
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\)", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, date#\d+, \d+\)", plan)) == 1


def test_dedup_pre_aggregates_before_its_shuffle(spark):
    """A symbol holding a large share of the raw rows is collapsed map-side first."""
    study = pl.RiskStudy.from_tables(spark, SF_SMALL, keep=())
    plan = _plan(study.stock_returns)
    lines = plan.splitlines()
    ex = next(i for i, l in enumerate(lines) if re.search(r"Exchange hashpartitioning\(symbol#\d+, date#", l))
    assert any("partial_max(open" in l for l in lines[ex + 1:ex + 4])


def test_scenarios_have_no_shuffle(spark):
    """Trials are a narrow projection over spark.range: no exchange, no join."""
    study = pl.RiskStudy.from_tables(spark, SF_SMALL, n_trials=100)
    df = study.scenario_draws
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    main = text.split("===== Subqueries =====")[0]
    assert "Range" in main
    assert "Exchange" not in main and "Join" not in main


def test_factors_are_scanned_once_in_a_study(spark):
    """Every factor output starts from the kept factor returns, not from the tables."""
    study = pl.RiskStudy.from_tables(spark, SF_SMALL, n_trials=100)
    for df in (study.feature_table, study.aligned_factors, study.factor_density(), study.factor_returns):
        assert "FileScan" not in _plan(df)


def test_union_scans_each_source_once(spark):
    from montevar.sources import fixtures as fx
    assert _plan(fx.factor_series_union(spark, SF_SMALL)).count("FileScan") == 2


def test_single_outputs_run_nothing_while_built(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    for name in ("fit_linear", "factor_moments", "trial_returns", "factor_density", "stock_returns", "scenarios"):
        queries()[name](spark, SF_SMALL)
    ran = [j for j in tracker.getJobIdsForGroup("build")]
    spark.sparkContext.setJobGroup("rest", "")
    # Readers look at file footers; nothing reads the tables' rows.
    assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in ran)
