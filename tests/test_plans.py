"""Physical plans: how often a result table reads its sources, and what its
windows and exchanges look like."""

import re

import pytest

from cohortspark.plans.registry import QUERIES

from .conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan that ran, without the adaptive plan's initial one."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan = execution.executedPlan().toString()
    return plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


@pytest.mark.parametrize("key, scans", [
    ("fig2a_counts", 3), ("fig2c_counts", 3), ("analyte_label", 3), ("attach_cohort_size", 3),
    ("fig4a_correlation", 3), ("fig4a_titre2", 3), ("pearson_log_log", 3), ("pearson_titre2", 3),
    ("regression_log_log", 3), ("regression_titre2", 3), ("regroup_cohort", 2)])
def test_sources_are_read_once(spark, key, scans):
    assert len(re.findall("FileScan parquet", plan_of(QUERIES[key](spark, SF_SMALL)))) == scans


@pytest.mark.parametrize("key", ["fig2b_tests", "fig4b_spearman", "figS1_rank_sum",
                                 "median_by_analyte", "mid_rank", "fig3b_strip", "bonferroni"])
def test_plans_are_lazy_and_reuse_the_fold(spark, key):
    """No job while the plan is built; no range exchange; the histogram's
    readers share its shuffle when the plan runs."""
    group = f"build-{key}"
    spark.sparkContext.setJobGroup(group, key)
    df = QUERIES[key](spark, SF_SMALL)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0
    spark.sparkContext._jsc.clearJobGroup()
    plan = final_plan(df)
    assert "rangepartitioning" not in plan
    assert "ReusedExchange" in plan


def test_category_order_has_no_window_over_all_categories(spark):
    plan = plan_of(QUERIES["category_order"](spark, SF_SMALL))
    # what meets in one task is the cut points' sketch and the slices' totals
    for line in plan.split("\n"):
        if re.search(r"Window .*\], \[\]", line):
            assert "__slice" in line or "__t" in line, line
