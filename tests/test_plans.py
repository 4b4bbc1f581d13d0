"""Plan-shape guards for the performance fixes (single scan, hash aggregation, pruning)."""

import re

import __spark_entry__ as E
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ran(df) -> str:
    """The plan that ran, in which a stage used twice stands once."""
    df.collect()
    plan = _plan(df)
    return plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")] if "== Final Plan ==" in plan else plan


def _scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet", plan))


def test_factor_top10_single_scan_hash_aggregates(spark):
    p = _ran(E.queries()["factor_top10"](spark, SF))
    assert _scans(p) == 1
    assert "SortAggregate" not in p


def test_distribution_single_scan_and_pruned(spark):
    df = E.queries()["demand_distribution"](spark, SF)
    p = _plan(df)
    assert _scans(p) == 1
    assert "ReadSchema: struct<text:string>" in df._jdf.queryExecution().simpleString()


def test_theme_ranking_reads_the_posts_once(spark):
    """The ranks come from a table of the themes."""
    assert "documents.parquet" not in _plan(E.queries()["theme_ranking"](spark, SF))


def test_factor_counts_have_no_window(spark):
    p = _plan(E.queries()["factor_counts"](spark, SF))
    assert "Window" not in p and "SortAggregate" not in p


def test_factor_rows_single_scan(spark):
    assert _scans(_plan(E.queries()["factor_rows"](spark, SF))) == 1


def test_evaluation_reads_the_posts_once(spark):
    """Everything after the counts of (truth, pred) reads that small table."""
    p = _plan(E.queries()["evaluation_report"](spark, SF))
    assert "documents.parquet" not in p and "labels.parquet" not in p
