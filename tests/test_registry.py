import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.compare import TABLES, canonical, connect

SMALL = "/root/testdata/sf0.001"
SPOT = (
    "clean_prices", "agg_adv", "agg_covariance", "win_rsi", "win_walk_forward", "join_asof_backward", "uni_monthly_eligible", "pf_nav_rebalanced",
    "pf_mdp_long_only", "join_purge_theta", "chk_pit_17", "scan_source_manifest",
)


def test_every_sql_text_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 150


def test_flagship_runs(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 6 and abs(sum(r.weight for r in rows) - 1) < 1e-4


@pytest.mark.parametrize("name", SPOT)
def test_spot_queries_match_their_sql(spark, name):
    con = connect(SMALL)
    frame = entry_module.queries()[name](spark, SMALL)
    names, left = canonical([tuple(r) for r in frame.collect()], frame.columns)
    cursor = con.execute(entry_module.oracle_sql()[name])
    other, right = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert names == other and left == right and len(TABLES) == 14 and duckdb.__version__


@pytest.mark.parametrize("name", ["agg_covariance", "join_month_grid", "join_asof_backward", "agg_adv_asof", "uni_representatives", "pf_scorecard", "filter_available_asof"])
def test_no_pairwise_join_is_planned(spark, name):
    plan = entry_module.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["filter_valid_window", "agg_adv", "cache_coverage"])
def test_dates_reach_the_scan(spark, name):
    plan = entry_module.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_quarantine_reads_the_lines_once(spark):
    frame = entry_module.queries()["anomaly_quarantine"](spark, SMALL)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("Relation [l_orderkey") == 1


def test_month_arithmetic_clamps_to_the_month():
    import datetime

    from tidemark.sources.panel import _months_before

    assert _months_before(datetime.date(2024, 3, 31), 1) == datetime.date(2024, 2, 29)
    assert _months_before(datetime.date(2024, 1, 15), 1) == datetime.date(2023, 12, 15)
    assert _months_before(datetime.date(2024, 12, 31), 24) == datetime.date(2022, 12, 31)
