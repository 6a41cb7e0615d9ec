"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"model_label", "prompt_type", "gap"}
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.difference(df, con, sql) is None


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_top_n_drops_rows_before_the_shuffle(spark):
    assert plan_of(spark, "top_n_per_group").count("WindowGroupLimit") == 2


def test_first_per_key_combines_before_the_shuffle(spark):
    plan = plan_of(spark, "first_occurrence")
    assert "partial_min_by" in plan and "Window" not in plan


def test_mean_scores_scan_once_and_shuffle_cells(spark):
    plan = plan_of(spark, "baseline_gap")
    assert plan.count("FileScan") == 2 and "partial_var_pop" in plan


def test_row_level_scores_do_not_shuffle_rows(spark):
    assert "hashpartitioning" not in plan_of(spark, "zscore_groups")


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(spark, "group_means")
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan
    plan = plan_of(spark, "manifest_unique")
    assert "EqualTo(l_returnflag,A)" in plan
